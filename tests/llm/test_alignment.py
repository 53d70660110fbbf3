"""Alignment of two tokenizers against groups cut at shared ends and counted pair by pair."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sluice.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encoded(texts):
    """Ids and token bytes of each text by both libraries; none where the bytes differ."""
    import sentencepiece
    import tokenizers

    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    rest = [b for b in range(256) if b not in chars.values()]
    chars |= {chr(256 + k): b for k, b in enumerate(rest)}
    for text in texts:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = s.encode(text or "")
        of_a = [bytes(chars[c] for c in t.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [s.id_to_piece(i)]]
        whole = b" " + (text or "").encode()
        yield ((a, of_a), (b, of_b)) if text and b"".join(of_a) == whole and b"".join(of_b) == whole else (([], []), ([], []))


def cut(side, ends):
    ids, texts = side
    out, at, open_ = [], 0, []
    for i, t in zip(ids, texts, strict=True):
        open_.append(i)
        at += len(t)
        if at in ends:
            out.append(open_)
            open_ = []
    return out


def by_hand(rows):
    both = []
    for (doc, _), (a, b) in zip(rows, encoded([t for _, t in rows]), strict=True):
        ends = set(np.cumsum([len(x) for x in a[1]]).tolist()) & set(np.cumsum([len(x) for x in b[1]]).tolist())
        groups = list(zip(cut(a, ends), cut(b, ends), strict=True))
        both.append((doc, a[0], b[0], groups, Counter((x, y) for p, q in groups for x in p for y in q)))
    count = Counter(p for *_, links in both for p in links)
    most: dict = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    for doc, a, b, groups, links in both:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield doc, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), digest


EXTRA = ["<|endoftext|> and <s> are plain text </s>", "a▁b", "  two  spaces ", "\ttab\n\nlines", "😀" * 300, "=" * 999, "1" * 77, "naïve Ångström ﬁ   nbsp", "<0x41>", "日本語の文章は空白なしで続く。" * 20, " ", "\x00 null"]


@pytest.mark.parametrize("broadcast", [alignment.MOST_BROADCAST, 0])
def test_report_against_brute_force(spark, odd, documents, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(alignment, "CHUNK", 2000 if broadcast else alignment.CHUNK)
    extra = spark.createDataFrame(list(enumerate(EXTRA)), "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra).unionByName(documents.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in alignment.report(docs, A, B).collect()]
    assert sorted(got, key=str) == sorted(by_hand(rows), key=str)


def test_both_encoders_agree(documents):
    files = open(A, encoding="utf-8").read(), open(B, "rb").read()
    texts = [" " + (r.text or "") for r in documents.limit(100).collect()] + [" " + t for t in EXTRA]
    encoders = alignment.Encoders(*files)
    assert encoders.first(texts) == alignment.Encoders._general(files[0])(texts)


def test_pairs_in_parts(spark, documents, monkeypatch):
    texts = [(r.text or "").encode() for r in documents.limit(60).collect()]
    encoders = alignment.Encoders(open(A, encoding="utf-8").read(), open(B, "rb").read())
    whole = alignment.Aligned(encoders, texts).links()
    monkeypatch.setattr(alignment, "PAIRS", 7)
    assert all((x == y).all() for x, y in zip(whole, alignment.Aligned(encoders, texts).links(), strict=True))


def test_groups_have_their_bytes(spark, odd):
    texts = {r.doc_id: r.text for r in spark.createDataFrame(list(enumerate(EXTRA)), "doc_id long, text string").collect()}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    found: dict = {}
    for r in alignment.groups(df, A, B).collect():
        found.setdefault(r.doc_id, []).append(r)
    encoders = alignment.Encoders(open(A, encoding="utf-8").read(), open(B, "rb").read())
    for doc, rows in found.items():
        whole = b" " + texts[doc].encode()
        rows.sort(key=lambda r: r.start)
        assert rows[0].start == 0 and rows[-1].end == len(whole)
        for r in rows:
            assert b"".join(encoders.texts[i] for i in r.a) == whole[r.start : r.end] == b"".join(encoders.pieces[i] for i in r.b)
    assert alignment.groups(odd.limit(0), A, B).isEmpty() and alignment.report(odd.limit(0), A, B).isEmpty()


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=30))
def test_coalesced_intervals(spans):
    starts, ends = np.array([a for a, _ in spans], np.int64), np.array([a + n for a, n in spans], np.int64)
    group = alignment.coalesced(starts, ends)
    for i in range(len(spans)):
        for j in range(len(spans)):
            inside = {p for k in range(len(spans)) if group[k] == group[i] for p in range(starts[k], ends[k])}
            assert (group[i] == group[j]) == ({*range(starts[j], ends[j])} <= inside)
