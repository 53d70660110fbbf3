"""A chain of operators from a declarative specification, for a batch table or a micro-batch alike."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scratch import listed, read_text, removed, shared_path, write_new
from sluice.operators import changes, columns, contracts, enrich, merge, protect, rows, scripts
from sluice.sources import database, files, jdbc, messages, registry, sinks, zipcsv
from sluice.sources.versioned import VersionedTable

def _named(step: dict, *names: str, default: object = None) -> object:
    """The first of several names of an option that a step gives."""
    return next((step[n] for n in names if step.get(n) is not None), default)


def _field(step: dict) -> str:
    return _named(step, "column", "field")


def _dates(df: DataFrame, step: dict) -> DataFrame:
    source = _named(step, "source_format", "input_format", default="%Y%m%d")
    target = _named(step, "target_format", "output_format", default="%Y-%m-%d")
    return columns.reformat_date(df, _field(step), source, target, _named(step, "target_column", "new_name"))


def _renamed(df: DataFrame, step: dict) -> DataFrame:
    return columns.rename_columns(df, step.get("mapping") or {_field(step): _named(step, "new_name", "target", "value")})


#: Names of the column steps of a specification and of the options of each.
OPTIONS = {
    **dict.fromkeys(("filter",), ("expression",)),
    **dict.fromkeys(("select", "select_columns", "select_fields", "keep_columns", "drop", "drop_columns", "drop_fields"), ("columns", "fields")),
    **dict.fromkeys(("rename", "rename_field", "rename_column"), ("mapping", "column", "field", "new_name", "target", "value")),
    **dict.fromkeys(("cast", "type_cast"), ("column", "field", "target_type")),
    **dict.fromkeys(("date_format", "format_date", "date_transform"), ("column", "field", "source_format", "target_format", "input_format", "output_format", "target_column", "new_name")),
    "add_constant": ("column", "value"),
    "drop_nulls": ("column",),
    "mask": ("columns",),
    "camel_case": (),
    "expression": ("target_column", "expression"),
    "timestamp": ("column",),
    **dict.fromkeys(("script", "script_transform"), ("code", "path", "module", "function", "flavour", "schema", "timeout")),
    "plugin": ("name",),
}
#: Column steps by name: (frame, step) -> frame. Casts, scripts and plugins have branches of their own.
STEPS = {
    **dict.fromkeys(("filter",), lambda df, s: rows.where(df, s["expression"])),
    **dict.fromkeys(("select", "select_columns", "select_fields", "keep_columns"), lambda df, s: columns.select_columns(df, _named(s, "columns", "fields"))),
    **dict.fromkeys(("drop", "drop_columns", "drop_fields"), lambda df, s: columns.drop_columns(df, _named(s, "columns", "fields"))),
    **dict.fromkeys(("rename", "rename_field", "rename_column"), _renamed),
    **dict.fromkeys(("date_format", "format_date", "date_transform"), _dates),
    "add_constant": lambda df, s: columns.add_constant(df, s["column"], s["value"]),
    "drop_nulls": lambda df, s: rows.drop_nulls(df, [s["column"]]),
    "mask": lambda df, s: columns.mask(df, s["columns"]),
    "camel_case": lambda df, s: columns.camel_case_names(df),
    "expression": lambda df, s: columns.row_expression(df, s["target_column"], s["expression"]),
    "timestamp": lambda df, s: df.withColumn(s["column"], F.current_timestamp()),
}


def checked(steps: list[dict]) -> list[dict]:
    """The steps, if their types and options are known; a misspelt option would be ignored otherwise."""
    for step in steps:
        if step.get("type") not in OPTIONS:
            raise ValueError(f"unknown step type {step.get('type')!r}; known are {', '.join(OPTIONS)}")
        unknown = set(step) - {"type", *OPTIONS[step["type"]]}
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)} of step {step['type']}; known are {', '.join(OPTIONS[step['type']])}")
    return steps


def _database(spark: SparkSession, s: dict) -> DataFrame:
    """A query, or a table read by ranges of a column."""
    if "query" in s:
        return jdbc.read(spark, s["url"], s["query"], s.get("fetch", 10_000), **s.get("options", {}))
    if s.get("balanced"):
        return jdbc.read_balanced(spark, s["url"], s["table"], s["shard_column"], s["shards"], s["first"], s["last"], **s.get("options", {}))
    if "shard_column" in s:
        return jdbc.read_sharded(spark, s["url"], s["table"], s["shard_column"], s["first"], s["last"], s["shards"], **s.get("options", {}))
    return jdbc.read(spark, s["url"], f"SELECT * FROM {s['table']}", s.get("fetch", 10_000), **s.get("options", {}))


def _messages(spark: SparkSession, s: dict) -> DataFrame:
    """JSON messages of a broker or of a source known by an alias, read as a batch."""
    given = messages.kafka_options(s["servers"], s["topic"], s.get("group"), "replay_from_start") if "servers" in s else {}
    raw = spark.read.format(registry.resolve(spark, s.get("format", "kafka"))).options(**given, **s.get("options", {})).load()
    return messages.parse(raw, s["schema"], s.get("value", "value"), s.get("payload"))


def _bodies(spark: SparkSession, s: dict) -> DataFrame:
    """JSON response bodies, a file each, or a column of a table."""
    df = spark.read.parquet(s["path"]) if "column" in s else spark.read.text(s["path"], wholetext=True)
    return messages.ingest_bodies(df, s.get("column", "value"), _schema(s["schema"]), s.get("data_key"), s.get("keep", []))


def _schema(schema: T.StructType | str) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


#: Readers of sources by type.
SOURCES: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "csv": lambda spark, s: files.csv(spark, s["path"], s.get("delimiter", ","), s.get("schema")),
    "parquet": lambda spark, s: files.parquet(spark, s["path"]),
    "sql": lambda spark, s: spark.sql(s["query"]),
    "database": _database,
    "documents": lambda spark, s: files.documents(spark, s["path"], _schema(s["schema"]), s.get("query"), s.get("projection"), format=s.get("format", "json")),
    "zip": lambda spark, s: zipcsv.read(spark, s["path"], s.get("schema"), **s.get("options", {})),
    "json_bodies": _bodies,
    "messages": _messages,
    "versioned": lambda spark, s: VersionedTable(spark, s["path"]).read(),
    "format": lambda spark, s: spark.read.format(registry.resolve(spark, s["format"])).options(**s.get("options", {})).load(*[s["path"]][: "path" in s]),
}
WATERMARKS = "job_id string, source string, watermark string"


@dataclass
class Result:
    """Rows for the destinations, violations of the contract, rows that keep it, dead letters of casts and scripts, and the watermark row.

    counts holds what a run that stores its tables saw while it wrote them: rows, violations, written and failed, and marks,
    the highest watermark of each source as text.
    """

    good: DataFrame
    violations: DataFrame
    valid: DataFrame | None = None
    letters: list[DataFrame] = field(default_factory=list)
    watermark: DataFrame | None = None
    counts: dict = field(default_factory=dict)
    began: float = field(default_factory=time.time)
    job: str = "job"
    stored: list[str] = field(default_factory=list)

    def discard(self) -> None:
        """Remove the tables that a run stored; its frames cannot be read afterwards."""
        for path in self.stored:
            removed(self.good.sparkSession, path)
        self.stored.clear()

    def progress(self, batch: int | None = None, failed: str | None = None) -> DataFrame:
        """One row: what was written and failed, and how fast."""
        seconds, written = time.time() - self.began, self.counts.get("written", 0)
        row = (self.job, batch, written, self.counts.get("failed", 0), round(seconds, 3), int(written / max(seconds, 0.001)), failed)
        return self.good.sparkSession.createDataFrame([row], "job_id string, batch long, rows_written long, rows_failed long, seconds double, rows_per_second long, error string")


@dataclass
class Pipeline:
    """contract -> watermark -> rules -> enrichment -> script -> encryption -> steps -> decryption."""

    spec: dict
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    plugins: scripts.Plugins = field(default_factory=scripts.Plugins)

    def __post_init__(self) -> None:
        checked(self.spec.get("steps", []))
        for source in self.spec.get("sources", []):
            if source.get("type") not in SOURCES:
                raise ValueError(f"unknown source type {source.get('type')!r}; known are {', '.join(SOURCES)}")

    @property
    def job(self) -> str:
        return self.spec.get("job_id", "job")

    @property
    def costly(self) -> bool:
        """Whether scripts or ciphers run, which cost far more a row than dealing it anew."""
        kinds = {step["type"] for step in self.spec.get("steps", [])}
        return bool({"script", "encrypt", "decrypt"} & set(self.spec) | {"script", "script_transform", "plugin"} & kinds)

    def apply(self, df: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, keep_checked: Callable[[DataFrame], DataFrame] | None = None, read: bool = False) -> Result:
        """The chain as one plan. Where rows part into good and bad ones, keep may store the tagged rows; else each reads the source.

        keep_checked does so for the rows that the contract has tagged. Rows that were read past a watermark are not filtered again.
        """
        spec = self.spec
        delta = spec.get("delta", {})
        df = changes.after(df, delta["watermark_column"], delta.get("initial_watermark")) if delta and not read else df
        good, bad = contracts.validate(df, spec.get("contract", {}), keep_checked or keep)
        out = Result(good, bad, good, job=self.job)
        out.watermark = changes.high_watermark(good, delta["watermark_column"]) if delta else None
        job = spec.get("job_id", "job")
        good = rows.apply_rules(good, spec.get("rules", []), spec.get("skip_unknown", False))
        for e in spec.get("enrichments", []):
            lookup, key, target = self.lookups[e["lookup"]], e["join_key"], e.get("target_field")
            good = enrich.nested(good, lookup, key, target, e.get("order", [])) if target and target != "_flatten_" else enrich.flattened(good, lookup, key, e.get("order", []))
        if "script" in spec:
            good = self._script(good, spec["script"], out, keep)
        if "encrypt" in spec:
            # Each pass would draw other nonces.
            good = keep(protect.encrypt_fields(good, spec["encrypt"]["fields"], spec["encrypt"]["key"]))
        for step in spec.get("steps", []):
            if step["type"] in ("cast", "type_cast"):
                good, dead = columns.split_casts(good, {_field(step): step["target_type"]}, keep)
                out.letters.append(contracts.dead_letters(dead, F.col("_error"), job))
            elif step["type"] in ("script", "script_transform"):
                good = self._script(good, step, out, keep)
            elif step["type"] == "plugin":
                good = self.plugins.execute(step["name"], good)
            else:
                good = STEPS[step["type"]](good, step)
        if "decrypt" in spec:
            good, dead = protect.decrypt_fields(good, spec["decrypt"]["fields"], spec["decrypt"]["key"], keep)
            out.letters.append(contracts.dead_letters(dead, F.col("_error"), job))
        out.good = good
        return out

    def _script(self, df: DataFrame, s: dict, out: Result, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if "function" in s:
            fn, flavour = s["function"], s["flavour"]
        elif "module" in s:
            fn, flavour = scripts.imported(s["module"])
        else:
            fn, flavour = scripts.compiled(s["code"] if "code" in s else read_text(df.sparkSession, s["path"]))
        good, dead = scripts.run_isolated(df, fn, flavour, s.get("schema", df.schema), s.get("timeout"), keep)
        out.letters.append(dead.select(F.lit(self.job).alias("job_id"), "row_payload", F.col("error").alias("error_trace"), F.lit(False).alias("replayed")))
        return good

    def _deltas(self) -> dict[str, dict]:
        """The watermark settings of each source that has any: its own, or those of the whole specification."""
        found = {s.get("name", str(k)): s.get("delta", self.spec.get("delta")) for k, s in enumerate(self.spec.get("sources", []))}
        return {name: delta for name, delta in found.items() if delta}

    def committed(self, spark: SparkSession) -> dict[str, str]:
        """The watermark that the last successful run left for each source."""
        if "watermarks" not in self.spec:
            return {}
        rows_ = VersionedTable(spark, self.spec["watermarks"], WATERMARKS).read().where(F.col("job_id") == self.job).collect()
        return {r.source: r.watermark for r in rows_}  # a row for each source of the specification

    def source(self, spark: SparkSession) -> DataFrame:
        """All sources of the specification, one after another, each past its watermark: the committed one, else the initial one."""
        marks, deltas, found = self.committed(spark), self._deltas(), {}
        for k, s in enumerate(self.spec["sources"]):
            name, df = s.get("name", str(k)), SOURCES[s["type"]](spark, s)
            if name in deltas:
                df = changes.after(df, deltas[name]["watermark_column"], marks.get(name, deltas[name].get("initial_watermark")))
            found[name] = df
        return next(iter(found.values())) if len(found) == 1 else rows.union_sources(found)

    def applied(self, df: DataFrame, read: bool = False) -> tuple[Result, DataFrame]:
        """The chain with its tables stored once each, and all dead letters; counts and watermarks are observed while they are written."""
        spark, seen, paths = df.sparkSession, {}, []
        deltas = self._deltas() if read else {}

        def kept(name: str, df: DataFrame, *what) -> DataFrame:
            seen[name] = Observation()
            return stored(spark, df.observe(seen[name], F.count(F.lit(1)).alias("n"), *what), paths)

        def checked_rows(tagged: DataFrame) -> DataFrame:
            bad = F.size("_errors") > 0
            of = lambda name: ~bad & (F.col("_source") == name if len(self.spec["sources"]) > 1 else F.lit(True))
            marks = [F.max(F.when(of(name), F.col(delta["watermark_column"]))).cast("string").alias(f"mark_{name}") for name, delta in deltas.items()]
            return kept("checked", tagged, F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"), *marks)

        result = self.apply(df, lambda df: stored(spark, df, paths), checked_rows, read)
        result.stored = paths
        result.good = kept("good", result.good)
        letters = reduce(DataFrame.unionByName, [contracts.violation_letters(result.violations, self.job), *result.letters])
        letters = kept("letters", letters)
        found = {name: o.get for name, o in seen.items()}
        marks = {name: found["checked"][f"mark_{name}"] for name in deltas}
        result.counts = {"rows": found["checked"]["n"], "violations": found["checked"]["bad"], "written": found["good"]["n"], "failed": found["letters"]["n"], "marks": marks}
        return result, letters

    def enforce(self, result: Result, letters: DataFrame) -> None:
        """Raise where a strict contract is violated or the failure policy breached. Percentages are of the whole run, and of the shards that the policy's expression `shard` names."""
        if self.spec.get("contract", {}).get("strict") and result.counts["violations"]:
            raise contracts.ContractViolation("rows violate a strict contract")
        policy = self.spec.get("failure_policy")
        if policy:
            contracts.enforce_policy(contracts.evaluate_policy(self._failures(result, policy.get("shard")), policy))

    def run(self, spark: SparkSession) -> Result:
        """Read past the watermarks; write dead letters; check strictness and failure policy; load destinations; commit the watermarks.

        Tagged rows are written once, in the shared folder, so scripts run once and all branches see the same rows. A
        breach raises after the dead letters are written and before any destination is. A progress row is written for a run
        that fails too. Watermarks, in the versioned table `watermarks`, move only after all destinations are loaded, so a run
        that fails is done again from where the last good one ended. The stored tables stay for the result's frames; discard
        removes them.
        """
        began = time.time()
        result, error = None, None
        try:
            result, letters = self.applied(self.source(spark), read=True)
            result.began = began
            if "dead_letters" in self.spec:
                sinks.replace(letters, f"{self.spec['dead_letters']}/run={uuid.uuid4().hex}")
            self.enforce(result, letters)
            self.load(result)
            new = [(self.job, name, mark) for name, mark in result.counts["marks"].items() if mark is not None]
            if "watermarks" in self.spec and new:
                table = VersionedTable(spark, self.spec["watermarks"], WATERMARKS, ["job_id", "source"], 1)
                table.merge(spark.createDataFrame(new, WATERMARKS), lambda before, now: merge.upsert(before, now, ["job_id", "source"]))
            return result
        except BaseException as e:
            error = f"{type(e).__name__}: {e}"[:1000]
            raise
        finally:
            if "progress" in self.spec:
                told = result or Result(spark.range(0), spark.range(0), job=self.job, began=began)
                sinks.append(told.progress(failed=error), self.spec["progress"])

    def load(self, result: Result, app: str | None = None, batch: int | None = None) -> None:
        """Load the destinations; rows that one refuses become dead letters too."""
        refused = sinks.fan_out(result.good, self.spec.get("destinations", []), app, batch)
        if refused:
            letters = database.letters_of(reduce(DataFrame.unionByName, refused), self.job)
            result.counts["refused"] = letters.count()
            if "dead_letters" in self.spec and result.counts["refused"]:
                name = f"{app}-{batch}-load" if app else uuid.uuid4().hex
                sinks.replace(letters, f"{self.spec['dead_letters']}/run={name}")

    def pending(self, spark: SparkSession) -> list[str]:
        """Runs whose dead letters wait for a replay."""
        path = self.spec["dead_letters"]
        done = {n.partition(".")[0] for n in listed(spark, f"{path}/_replayed")}
        return sorted(n for n in listed(spark, path) if n.startswith("run=") and n.partition("=")[2] not in done)

    def replay(self, spark: SparkSession, schema: T.StructType | str) -> Result | None:
        """Put the pending dead letters through the chain again as rows of a schema, load what is good, and mark their runs as replayed.

        Rows that fail again are dead letters of a new run. Marks are written after the destinations are loaded; with keyed destinations a
        replay that was cut short can be repeated.
        """
        path, runs = self.spec["dead_letters"], self.pending(spark)
        if not runs:
            return None
        letters = spark.read.schema(contracts.DEAD_LETTER).parquet(*[f"{path}/{r}" for r in runs])
        again = contracts.replay(letters.where(F.col("job_id") == self.job), _schema(schema))
        result, rejected = self.applied(again)
        sinks.replace(rejected, f"{path}/run={uuid.uuid4().hex}")
        self.load(result)
        for run in runs:
            write_new(spark, f"{path}/_replayed/{run.partition('=')[2]}.json", "{}")
        return result

    @staticmethod
    def _failures(result: Result, shard: str | None) -> DataFrame:
        """Rows and failures of the run; by shard too if the contract's rows tell it."""
        spark, counts = result.good.sparkSession, result.counts
        if not shard:
            n = counts["written"] + counts["failed"]
            row = (None, True, n, counts["failed"], round(100.0 * counts["failed"] / n, 2) if n else None)
            return spark.createDataFrame([row], "shard string, whole boolean, n long, failed long, percent double")
        of = lambda df, bad: df.select(F.expr(shard).alias("shard"), F.lit(bad).alias("bad"))
        both = of(result.valid, False).unionAll(of(result.violations, True))
        return contracts.failure_counts(both, F.col("shard"), F.col("bad"))


def stored(spark: SparkSession, df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """A frame written in the shared folder and read again; its folder is added to paths."""
    path = shared_path(spark)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
