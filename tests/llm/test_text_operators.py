"""Decontamination, quality, attribution, substrings, personal data, language, SimHash and BPE against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from sluice.llm import attribution, bpe, decontaminate, language, pii, quality, simhash, substrings

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def both(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=str)


# 1


def marked(docs, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows: dict = {}
    for name, text in items:
        w = re.findall(pattern, (text or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(name)
    for doc, text in docs:
        w = re.findall(pattern, (text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= {*range(k, k + n)}
                    found |= windows[tuple(w[k : k + n])]
        found = sorted(str(x) for x in found if x is not None)
        yield doc, len(w), len(hit), len(found), sha(",".join(found)), bool(hit)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old river bank"), (1, "the quick brown fox jumps over the lazy dog near the old river bank"), (2, "fox jumps"), (3, "jumps"), (None, "quick brown"), (4, ""), (5, None), (6, "..."), (7, "a b c d e f g h i j"), (8, "a b c d e f g h i j k")]
TEXTS = ["The QUICK brown fox jumps over the lazy dog near the old river bank!", "the quick brown fox jumps over the lazy dog near", "fox. jumps", "a b c d e f g h i", "a b c d e f g h i j", "x a b c d e f g h i j k a b c d e f g h i j", None, "", "nothing of it"]


@pytest.mark.parametrize("window,block", [(10, 250_000), (10, 8), (3, 250_000), (1, 5)])
def test_windows_of_items(spark, odd, window, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    found = decontaminate.match(docs, items, window, block_words=block)
    n_hit = F.aggregate("hits", F.lit(0), lambda n, x: n + x["b"] - x["a"])
    got = [(r.doc_id, r.n_words, r.n, len(r["items"]), sha(",".join(r["items"])), r.n > 0) for r in found.withColumn("n", n_hit).collect()]
    assert in_order(got) == in_order(marked(both(docs), ITEMS, window))


def test_decontaminated_texts_hold_no_window(spark, documents, benchmark, odd):
    clean = decontaminate.decontaminate(documents, benchmark)
    assert decontaminate.report(clean, benchmark).filter("contaminated").isEmpty()
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and in_order(kept.collect()) == in_order(odd.collect())  # nothing to cut, nothing changed
    untouched = decontaminate.report(documents, benchmark).filter("not contaminated").join(documents, "doc_id").join(clean.select("doc_id", F.col("text").alias("new")), "doc_id")
    assert untouched.filter("text <> new").isEmpty() and untouched.count() > 150
    assert decontaminate.report(odd.limit(0), benchmark).isEmpty()
    assert decontaminate.report(odd, benchmark.limit(0)).filter("contaminated").isEmpty()


def test_blocks_of_items_do_not_change_the_cut(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(8)]
    docs = [(9, "free text")]
    for a in range(8):
        for b in range(8):
            other = [f"x{j}" for j in range(16)]
            docs.append((100 + 10 * a + b, " ".join([items[a][1], *other[:8], items[b][1], *other[8:]])))  # 24 of 40 words are hit
            half = items[a][1].split()
            docs.append((200 + 10 * a + b, " ".join([*half[:6], items[b][1], *half[6:], *(f"y{j}" for j in range(30))])))  # a cut joins another window
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (decontaminate.decontaminate(docs, items, block_words=n) for n in (250_000, 24))
    assert in_order(map(tuple, one.collect())) == in_order(map(tuple, many.collect()))
    assert not one.where("doc_id between 100 and 199").count() and decontaminate.report(many, items).filter("contaminated").isEmpty()


# 2


def counted(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_verdicts(spark, documents, odd):
    for docs in (documents, odd):
        got = [tuple(r)[:7] for r in quality.report(docs).collect()]
        want = []
        for doc, text in both(docs):
            c = counted(text)
            want.append((doc, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        assert in_order(got) == in_order(want)
    found = quality.report(documents).collect()
    assert not any(r.kept and r.base_failed for r in found) and sum(r.kept for r in found) > 0.7 * len(found)
    assert quality.report(odd.limit(0)).isEmpty()


def test_quality_rejects_outliers_of_their_group(spark):
    rng = np.random.default_rng(1)
    text = lambda k, bad: " ".join("".join(rng.choice([*"abcdefgh"], rng.integers(2, 9))) + ("#$%" if bad else "") for _ in range(rng.integers(60, 200)))
    rows = [(k, text(k, k % 50 == 0), "en", "a") for k in range(600)]
    found = quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 50 != 0) for r in found)


def test_quality_rejects_an_outlier_of_each_statistic(spark):
    rng = np.random.default_rng(5)
    word = lambda a=2, b=9: "".join(rng.choice([*"abcdefghijklmnopqrst"], rng.integers(a, b)))
    some = lambda n, *size: [word(*size) for _ in range(n)]
    good = [" ".join(some(rng.integers(150, 300))) for _ in range(400)]
    passage = some(40, 5, 9)
    bad = {
        "length": " ".join(some(20_000, 5, 9)),
        "word": " ".join(some(200, 14, 20)),
        "symbols": " ".join(some(200) + ["####", "%%%%", "$$$$", "&&&&"] * 2 + some(20)),
        "lines": "\n".join([" ".join(some(150)), *["ab"] * 100]),
        "repeats": " ".join(some(100) + passage + some(20) + passage + some(20)),
    }
    rows = [(k, t, "en", "a") for k, t in enumerate([*good, *bad.values()])]
    found = {r.doc_id: r for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {name: (found[400 + k].base_failed, found[400 + k].kept) for k, name in enumerate(bad)} == dict.fromkeys(bad, (False, False))
    assert sum(found[k].kept for k in range(400)) >= 395


def log_det(x: np.ndarray) -> float:
    cov = quality.HALF_FACTOR * np.cov(x.T, bias=True) + np.diag([s**2 for s in quality.SPREAD.values()])
    return float(np.linalg.slogdet(cov)[1])


def searched(x: np.ndarray, rng: np.random.Generator, starts: int = 60) -> float:
    """Smallest log determinant of a half, from random starts with concentration steps until they settle."""
    best = np.inf
    for _ in range(starts):
        half, last = rng.permutation(len(x))[: len(x) // 2], np.inf
        while (now := log_det(x[half])) < last - 1e-6:
            last = now
            cov = quality.HALF_FACTOR * np.cov(x[half].T, bias=True) + np.diag([s**2 for s in quality.SPREAD.values()])
            off = x - x[half].mean(0)
            half = np.argsort((off @ np.linalg.inv(cov) * off).sum(1))[: len(x) // 2]
        best = min(best, last)
    return best


def test_smallest_determinant_of_contaminated_groups(spark):
    rng, groups = np.random.default_rng(8), {}
    for k in range(6):
        mixing = rng.normal(size=(5, 5))
        bulk = rng.normal(size=(400, 5)) @ mixing
        away = rng.normal(size=(40 * k, 5)) * 0.3 + rng.normal(size=5) * 8  # up to a third of a group in one place
        groups[f"g{k}"] = np.vstack((bulk, away)) if k else bulk
    rows = spark.createDataFrame([(g, [float(v) for v in x]) for g, at in groups.items() for x in at], "group string, x array<double>")
    found = {r.group: r for r in quality.searched(quality.materialize(rows), len(groups)).collect()}
    for g, x in groups.items():
        if len(x) < 600:  # halves are taken by bins of distance
            assert found[g].log_det <= searched(x, rng) + 0.15, g
        # A third in one spot makes the smallest determinant one of a half with that spot; the robust starts stay at the bulk.
        assert np.abs(np.array(found[g].mu) - x[:400].mean(0)).max() < 1.0, g


def test_quality_levels(spark):
    rows = [(k, "alpha beta gamma delta epsilon zeta eta theta iota " * 3 + " ".join(f"w{k}x{j}" for j in range(60 + k % 30)), "en", "big" if k < 30 else f"small{k % 4}") for k in range(45)]
    rows += [(100, rows[0][1], "xx", "lone")]
    found = {r.doc_id: r.level for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert found[0] == "source" and found[44] == "language" and found[100] == "all"


def test_estimate_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)) * [1, 2, 3, 4, 5] + [5, 4, 3, 2, 1]
    rows = spark.createDataFrame([("g", [float(v) for v in r]) for r in x], "group string, x array<double>")
    best = quality.estimates(rows, 1.0)
    got = [r.d for r in rows.join(best, "group").select(quality.distance().alias("d")).collect()]
    cov = np.cov(x.T, bias=True) + np.diag([s**2 for s in quality.SPREAD.values()])
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0))
    assert np.allclose(sorted(got), sorted(want))


# 4


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_adds_up(spark, odd, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    found = attribution.attribute(odd, PATH, ["source", "text"], separator="\n\n", rule=rule)
    got = [(r.doc_id, round(r.n, 6)) for r in found.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()]
    want: dict = {}
    for r in odd.collect():
        n = len(t.encode(f"{r.source or ''}\n\n{r.text or ''}", add_special_tokens=False).ids)
        want[r.doc_id] = want.get(r.doc_id, 0) + n
    assert dict(got) == want
    assert attribution.attribute(odd.limit(0), PATH, ["text"]).isEmpty()


def sections(fields: list[str], separator: str) -> list[tuple[int, int, int]]:
    """Field, number and end byte of each line of the rendered text, a line holding its break and a field's last one the separator."""
    out, at = [], 0
    for k, text in enumerate(fields):
        lines = text.split("\n")
        for n, line in enumerate(lines):
            last = n == len(lines) - 1
            at += len(line.encode()) + len((separator if k < len(fields) - 1 else "").encode() if last else b"\n")
            out.append((k, n, at))
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_tokens_of_each_section(spark, odd, rule):
    """Every byte is looked at by itself; the library's tokens have a character for each of their bytes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    special = spark.createDataFrame([(901, "a\nb\n\n\nc", "s\nt"), (902, "é\n😀\n　\nñ  x", ""), (903, "x\n" * 300, None), (904, "word\n\n\n\n  indented\n\tand\r\nmore", "z")], "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source").unionByName(special)
    want = Counter()
    for r in docs.collect():
        fields = [r.source or "", r.text or ""]
        ends = sections(fields, "\n")
        of_byte = [k for k, (_, _, end) in enumerate(ends) for _ in range(end - (ends[k - 1][2] if k else 0))]
        counts, at = [0.0] * len(ends), 0
        for token in t.encode("\n".join(fields), add_special_tokens=False).tokens:
            held = Counter(of_byte[at : at + len(token)])
            at += len(token)
            if rule == "start":
                counts[min(held)] += 1
            elif rule == "majority":
                counts[min(held, key=lambda k: (-held[k], k))] += 1
            else:
                for k, n in held.items():
                    counts[k] += n / len(token)
        want.update((r.doc_id, ("source", "text")[f], n, round(c, 6)) for (f, n, _), c in zip(ends, counts, strict=True))
    found = attribution.attribute(docs, PATH, ["source", "text"], rule=rule).collect()
    assert Counter((r.doc_id, r.field, r.section, round(float(r.n_tokens), 6)) for r in found) == want


def test_allocation_rules():
    sizes, ends = np.array([2, 4, 3]), np.array([3, 3, 9])
    assert attribution.allocate(sizes, ends, "start")[0].tolist() == [2, 0, 1]
    assert attribution.allocate(sizes, ends, "majority")[0].tolist() == [1, 0, 2]
    assert attribution.allocate(sizes, ends, "split")[0].tolist() == [1.25, 0, 1.75]
    assert attribution.allocate(sizes, ends, "split")[1].tolist() == [1, 0, 1]


# 5


@pytest.mark.parametrize("width", [35, 5, 2, 1, 60])
def test_repeated_passages(spark, documents, odd, width):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    seen: Counter = Counter()
    for _, text in both(docs):
        w = words(text)
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    want = []
    for doc, text in both(docs):
        w = words(text)
        gone = {p for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        want.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert in_order(map(tuple, substrings.report(docs, width).collect())) == in_order(want)


def test_repeats_removed_from_rows(odd):
    new = substrings.remove_repeats(odd, 35)
    assert new.columns == odd.columns and new.count() == odd.count()
    assert not new.filter("doc_id = 5 and text <> ''").count() and new.filter("text is null").count() == odd.filter("text is null").count()
    assert substrings.report(odd.limit(0)).isEmpty()


def test_covers_are_difference_covers():
    for v, places in substrings.COVERS.items():
        assert {(a - b) % v for a in places for b in places} == {*range(v)}


# 6

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def personal(text: str) -> list[str]:
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


TRICKY = ["a.b@c.d_e@f.g x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.4", "😀 4539 1488 0343 6467 é +1 (555) 555-1234 x", "4539148803436467@a.b +12345678 90-", "1 2 " * 5000, "@" * 10 + "a@b.c" * 3, "+1+2(3)4567890123", "a" * 50_000, "9.9.9.9" * 300, "a@b.c, d@e.f; 10.0.0.1"]


def test_base_spans(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string"))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(docs).collect()]
    want = []
    for doc, text in both(docs):
        spans = personal(text or "")
        want.append((doc, *(sum(s.startswith(k + ":") for s in spans) for k in PATTERNS), sha(",".join(spans))))
    assert in_order(got) == in_order(want)


def test_terms_that_disclose_an_entity(spark):
    near = [(k, f"Write to Zebulon today, or call {chr(97 + k)}x at zeb@corp.org. The Zebulon plan ({k}) is private") for k in range(4)]
    far = [(10 + k, f"The plan is to write today {k}; call the corp about {chr(97 + k % 26)}y") for k in range(200)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    text = dict(near)[0]
    found = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in spans[0].split(",")]
    assert ("email", "zeb@corp.org") in found and found.count(("remove", "Zebulon")) == 2
    assert not {"plan", "write", "today"} & {t.lower() for _, t in found}
    assert all(spans[k] == "" for k, _ in far)  # no text without an entity is touched
    new = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zebulon" not in new[0] and "[EMAIL]" in new[0] and new[10] == dict(far)[10]


def test_far_terms_disclose_an_entity(spark):
    rest = " ".join(["the plan is to write today and call the corp"] * 40)
    far = [(k, f"Zebulon says {rest} at zeb@corp.org") for k in range(4)]
    far = [(k, f"{t} {'again ' * (k + 1)}") for k, t in far]
    docs = spark.createDataFrame([*far, *((10 + k, f"{rest} again {k}") for k in range(200))], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zebulon" not in new[k] and "[EMAIL]" in new[k] and rest in new[k] for k, _ in far)
    assert all(new[10 + k] == f"{rest} again {k}" for k in range(200))


def test_repeated_entities_count_once_a_document(spark):
    docs = spark.createDataFrame([(k, f"common {'zeb@corp.org common ' * 300} {k}") for k in range(3)] + [(10 + k, f"common {k}") for k in range(20)], "doc_id long, text string")
    assert all("common" in r.text for r in pii.sanitise(docs).collect())  # 3 of 23 documents with the term hold the entity


def test_rare_terms_disclose_rare_entities(spark):
    near = [(0, "the customer 77-1204 or Al is at zeb@corp.org today"), (1, "the customer of 2012 is at ann@corp.org today")]
    docs = spark.createDataFrame([*near, *((10 + k, "the customer or plan is at work today in 2012") for k in range(3000))], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not {"77-1204", "Al"} & set(new[0].split()) and "[EMAIL]" in new[0] and "customer" in new[0]
    assert new[1] == "the customer of 2012 is at [EMAIL] today".replace(" of ", new[1][len("the customer") : new[1].index("2012")]) and new[10].endswith("2012")


def disclosures(docs: list[tuple[int, str]]) -> dict[int, set[tuple[str, int]]]:
    """Brute force: the disclosing terms of each document, with their level."""
    of_class = ("[^@]+$", "^[0-9]+[.][0-9]+", "^(?:[^0-9]*[0-9]){6}", "^(?:[^0-9]*[0-9]){4}")
    entities, terms = {}, {}
    for doc, text in docs:
        found = [(*PATTERNS,).index(x.split(":")[0]) for x in personal(text)]
        values = [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in personal(text)]
        entities[doc] = {("value", k, v) for k, v in zip(found, values, strict=True)} | {("class", k, re.search(of_class[k], v.lower()).group()) for k, v in zip(found, values, strict=True)}
        terms[doc] = {t.lower() for t in regex.findall(pii.TERM, text)}
    n_e, n_t = (Counter(x for of in sets.values() for x in of) for sets in (entities, terms))
    n_et = Counter((e, t) for doc in entities for e in entities[doc] for t in terms[doc])
    n, z, want = len(docs), pii.CONFIDENCE, {}
    for doc in entities:
        for e in entities[doc]:
            for t in terms[doc]:
                k, part = n_t[t], n_et[e, t] / n_t[t]
                low = (part + z * z / (2 * k) - z * math.sqrt(part * (1 - part) / k + z * z / (4 * k * k))) / (1 + z * z / k)
                share = math.log(low * n / n_e[e]) / math.log(n / n_e[e]) if n_e[e] < n else 0
                level = 5 if share >= pii.REMOVE and low >= pii.REMOVE_SHARE else 4 if share >= pii.GENERALISE and low >= pii.GENERALISE_SHARE else 0
                if level:
                    want.setdefault(doc, {})[t] = max(want.get(doc, {}).get(t, 4), level)
    return want


def added(text: str, levels: dict[str, int]) -> list[tuple[int, int, str]]:
    """The spans of the terms, between blanks or as runs, beside the base spans and not within each other."""
    beside = text
    for x in personal(text):
        a, b = map(int, x.split(":")[1:])
        beside = beside[:a] + "\0" * (b - a) + beside[b:]
    found = {m.span() for p in (pii.TERM, pii.RUN) for m in regex.finditer(p, beside) if m.group().lower() in levels}
    kept, end = [], 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            kept.append((a, b, pii.ADDED[levels[beside[a:b].lower()] - 4]))
        end = max(end, b)
    return kept


def test_all_added_spans(spark, documents):
    crafted = [(5000 + k, f"Mr. O'Hara-Lund ({k % 3}) at desk-{k} a{k % 5}@mail{k % 2}.org, or (O'Hara-Lund's) 10.1.2.{k % 4} \U0001f600 +49 30 123456{k % 3}0") for k in range(12)]
    docs = documents.select("doc_id", "text").where("text is not null").unionByName(spark.createDataFrame(crafted, "doc_id long, text string"))
    rows = both(docs)
    levels = disclosures(rows)
    n = 0
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for doc, text in rows:
        got = [x for x in spans[doc].split(",") if x.split(":")[0] in pii.ADDED]
        want = [f"{kind}:{a}:{b}" for a, b, kind in added(text, levels.get(doc, {}))]
        assert got == want, doc
        n += len(got)
    assert n > 100


def test_levels_do_not_rise_with_the_corpus(spark):
    near = [(0, "the customer Zebulon is at zeb@corp.org today")]
    for n in (2_000, 80_000):
        rest = spark.range(10, 10 + n).selectExpr("id as doc_id", "concat('the customer is at work today ', id % 50) as text")
        docs = spark.createDataFrame(near, "doc_id long, text string").unionByName(rest)
        assert pii.sanitise(docs).where("doc_id = 0").first().text == "the customer [TERM] is at [EMAIL] today"


def test_many_entities_and_rare_terms_of_one_text(spark):
    many = " ".join(f"name{k}x user{k}@mail{k}.org" for k in range(2000))
    docs = spark.createDataFrame([(0, many), *((k, "plain words of other documents") for k in range(1, 50))], "doc_id long, text string")
    told = pii.report(docs).where("doc_id = 0").first()
    assert told.n_email == 2000 and told.spans.count("general") + told.spans.count("remove") == 2000


def test_long_texts_take_linear_work(spark):
    docs = spark.createDataFrame([(1, "12," * 100_000), (2, "a@b.cc " * 30_000), (3, "1.2.3.4," * 30_000)], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert new[1] == "12," * 100_000 and new[2] == "[EMAIL] " * 30_000 and new[3] == "[IP]," * 30_000


def test_sanitised_rows_keep_their_shape(odd):
    new = pii.sanitise(odd)
    assert new.columns == odd.columns and new.count() == odd.count() and new.filter("text is null").count() == 2
    assert pii.report(odd.limit(0).select("doc_id", "text")).isEmpty()


# 7


def test_language(spark, documents, odd):
    found = language.report(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    filters = language.trained(documents)
    some = {r.text: (p.lang_pred, p.score) for r, p in zip(odd.select("text").collect(), language.predict(odd, filters).collect(), strict=True)}
    assert some[None] == some[""] == some["1 2 3 " * 50] == (language.UNKNOWN, 0.0) and some["A."][0] != language.UNKNOWN
    kept = language.keep_identified(odd, filters)
    assert kept.columns == odd.columns and kept.filter("text is null or trim(text) = ''").isEmpty()
    assert language.report(odd.limit(0)).isEmpty()
    assert {r.lang_pred for r in language.predict(documents, language.learn(documents.limit(0))).collect()} == {language.UNKNOWN}


def gram_set(text: str) -> set[bytes]:
    plain = re.sub(rb" +", b" ", b" " + re.sub(rb"[^a-z\x80-\xff]", b" ", text.translate(LOWER).encode()) + b" ")
    return {plain[k : k + 4] for k in range(len(plain) - 3)}


def test_filters_hold_every_gram_of_every_language(spark, documents):
    some = documents.where("lang is not null and text is not null").limit(150)
    filters = language.learn(some)
    held = {}
    for r in some.collect():
        held.setdefault(r.lang, set()).update(gram_set(r.text))
    assert filters.languages == sorted(held)
    every = sorted(set().union(*held.values()))
    mask = filters.masks(np.array([int.from_bytes(g) for g in every], np.uint32))
    lacking = hits = 0
    for i, name in enumerate(filters.languages):
        found = mask[i // 8] >> (i % 8) & 1
        want = np.array([g in held[name] for g in every])
        assert (found[want] == 1).all()
        lacking, hits = lacking + int((~want).sum()), hits + int(found[~want].sum())
    assert hits <= 0.02 * lacking


def test_corrected_shares_match_exact_counts(spark, documents):
    filters = language.learn(documents)
    held = {}
    for r in documents.where("lang is not null and text is not null").collect():
        held.setdefault(r.lang, set()).update(gram_set(r.text))
    text = next(r.text for r in documents.where("length(text) > 3000").collect()) + " zq xqj wvk jjq" * 20
    plain = re.sub(rb" +", b" ", b" " + re.sub(rb"[^a-z\x80-\xff]", b" ", text.translate(LOWER).encode()) + b" ")
    each = [plain[k : k + 4] for k in range(len(plain) - 3)]
    for name, share in zip(filters.languages, filters.shares(text.encode()), strict=True):
        assert abs(share - sum(g in held[name] for g in each) / len(each)) < 0.02


def test_pieces_of_a_text_hold_each_gram_once(monkeypatch):
    text = "das ist ein ümlaut, and some more wörds".encode() * 40
    whole = np.concatenate([*language.grams(text)])
    monkeypatch.setattr(language, "STEP", 7)
    assert (np.concatenate([*language.grams(text)]) == whole).all() and len(whole) == len(language.folded(text)) - 3


def test_pipeline_drops_texts_of_no_known_language(spark, documents, sf_dir):
    import corpus_pipeline as p

    strange = ["Съешь же ещё этих мягких французских булок", "これは日本語の文章です", "QWxhZGRpbjpvcGVuIHNlc2FtZQ8f9aKx03jdLLqpwZ", "xqzt vvkk qjxw zzpf wqkj hgfx"]
    docs = documents.unionByName(spark.createDataFrame([(9001 + k, t, None, None, None) for k, t in enumerate(strange)], documents.schema))
    kept = {r.doc_id for r in p.language_id(spark, docs, sf_dir).collect()}
    assert not {9001 + k for k in range(len(strange))} & kept and len(kept) > 0.95 * documents.count()


def test_language_is_blind_to_held_out_labels(documents):
    changed = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert in_order(map(tuple, language.report(documents).collect())) == in_order(map(tuple, language.report(changed).collect()))


# 8


def print_of(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints: list[int], distance: int) -> list[int]:
    of = [*range(len(prints))]

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(prints))]


def test_simhash_components(documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    rows = both(docs)
    prints = [print_of(t) for _, t in rows]
    roots, least = linked(prints, 2), {}
    for (doc, _), r in zip(rows, roots, strict=True):
        least[r] = min([x for x in (least.get(r), doc) if x is not None], default=None)
    want = [(doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(rows, prints, roots, strict=True)]
    assert in_order(map(tuple, simhash.near_duplicates(docs).collect())) == in_order(want)


@pytest.mark.parametrize("limit", [1 << 15, 4])
def test_dense_fingerprints_keep_every_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "ROOT_MEMBERS", limit)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = {base ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for _ in range(300)} | {int(x) for x in rng.integers(1 << 62, size=200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r.fp & simhash.FULL: r["first"] & simhash.FULL for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2)).collect()}
    groups: dict = {}
    for p, r in zip(prints, linked(prints, 2), strict=True):
        groups.setdefault(r, set()).add(p)
    got: dict = {}
    for p in prints:
        got.setdefault(found.get(p, p), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in got.values()}


def similar_groups(texts: list[str | None], width=5, similarity=0.8) -> list[int]:
    """Brute force: for each text the first text of its component by similarity of shingle sets."""
    sets = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    of = [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def test_one_of_each_group_stays(spark, documents, odd):
    rows = sorted((r.doc_id, r.text) for r in documents.where("text is not null").collect())
    of = similar_groups([t for _, t in rows])
    kept = simhash.keep_first(documents.where("text is not null"))
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for k, (d, _) in enumerate(rows) if of[k] == k]
    some = simhash.keep_first(odd)
    assert some.columns == odd.columns and some.count() == len(set(similar_groups([t for _, t in both(odd)])))
    assert simhash.near_duplicates(odd.limit(0)).isEmpty() and simhash.keep_first(odd.limit(0)).isEmpty()


def test_choice_of_a_row_does_not_follow_the_input(spark):
    rows = [(1, "a text", "x"), (1, "a text", "y"), (1, "a text", None), (2, "a text", "w"), (None, "other", "v"), (None, "other", "u")]
    first, second = (spark.createDataFrame(r, "doc_id long, text string, tag string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert in_order(map(tuple, simhash.keep_first(first).collect())) == in_order(map(tuple, simhash.keep_first(second).collect()))


@pytest.mark.parametrize("run", [2048, 8])
def test_large_groups_of_near_copies(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    rng, texts = np.random.default_rng(5), []
    for _ in range(3):
        base = rng.integers(0, 500, 150)
        for _ in range(120):
            edited = base.copy()
            edited[rng.integers(0, 150, 2)] = rng.integers(0, 500, 2)
            texts.append(" ".join(f"w{x}" for x in edited))
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 500, 150)) for _ in range(150)]
    of = similar_groups(texts)
    kept = simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(of)) and len(set(of)) == 153


@pytest.mark.parametrize("texts", [1_000, 1_000_000])
def test_recall_at_the_similarity(texts):
    """Pairs just above the limit share a root and are near enough about as often as RECALL says, whatever the number of texts."""
    rng, found = np.random.default_rng(6), 0
    bits, tables, distance = simhash.plan(texts, 0.8)
    orders = [np.random.default_rng((simhash.SEED, t)).permutation(64 * simhash.WORDS)[:bits] for t in range(tables)]
    for _ in range(300):
        base = [f"v{x}" for x in rng.integers(0, 1 << 30, 300)]
        other = list(base)
        for at in rng.choice(60, 6, replace=False):
            other[5 * at + 2] = "new"  # 30 of 296 shingles: a similarity of 0.82
        a, b = (np.unpackbits(np.array([int(x) for x in simhash.wide_fingerprint(" ".join(t).encode(), 5)], ">u8").view(np.uint8)) for t in (base, other))
        found += (a != b).sum() <= distance and any((a[o] == b[o]).all() for o in orders)
    assert found >= 270


# 10


def test_bpe_round_trip(spark, documents, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    special = spark.createDataFrame([(1, "a<|endoftext|> b<|endoftext|><|endoftext|>"), (2, "don't  we'll\n\n  x "), (3, "\x1c\x85b　c  "), (4, "ab" * 3000 + "\U0001f600" * 50)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(special)
    want = []
    for doc, text in both(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert in_order(map(tuple, bpe.report(docs, PATH).collect())) == in_order(want)
    back = bpe.decode(bpe.encode(special, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, special.collect()))
    assert bpe.report(odd.limit(0), PATH).isEmpty()
