"""User code on batches: Arrow, pandas or record functions, with bad rows isolated inside the worker."""

from __future__ import annotations

import importlib
import json
import multiprocessing
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

FLAVOURS = ("arrow", "pandas", "polars", "records")


def compiled(code: str) -> tuple[Callable, str]:
    """The function of a script and its flavour, by its name; raises SyntaxError or ValueError."""
    names: dict = {}
    exec(compile(code, "<script>", "exec"), names)
    return chosen(names)


def imported(module: str) -> tuple[Callable, str]:
    """The function of a module that the driver and the executors can import, and its flavour."""
    return chosen(vars(importlib.import_module(module)))


def chosen(names: dict) -> tuple[Callable, str]:
    for name, flavour in (("transform_df", "pandas"), ("transform_polars", "polars"), ("transform_records", "records"), ("transform", "arrow")):
        if callable(names.get(name)):
            return names[name], flavour
    raise ValueError("the script defines no transform, transform_df, transform_polars or transform_records")


class Child:
    """A process of its own that runs a script on batches, and is killed if one takes too long, whatever the script is doing.

    It is forked from the worker when first needed, and anew after a kill, so nothing of the script is pickled.
    """

    def __init__(self, fn: Callable, flavour: str):
        self.fn, self.flavour, self.process, self.pipe = fn, flavour, None, None
        # What pyarrow imports when it first converts rows is imported here once, not in each child.
        pa.Table.from_pylist(pa.table({"a": [1]}).to_pylist()).to_pandas()

    def _serve(self, pipe) -> None:
        self.pipe.close()  # the worker's end, so that its death ends this process too
        pipe.send_bytes(b"ready")
        while True:
            try:
                given = pipe.recv_bytes()
            except EOFError:
                return
            batch = pa.ipc.open_stream(given).read_all().combine_chunks().to_batches()
            try:
                out = _apply(self.fn, self.flavour, batch[0])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, out.schema) as writer:
                    writer.write_table(out)
                pipe.send_bytes(b"+" + sink.getvalue().to_pybytes())
            except BaseException as e:  # noqa: BLE001  the script is the user's
                pipe.send_bytes(b"-" + f"{type(e).__name__}: {e}".encode())

    def apply(self, batch: pa.RecordBatch, seconds: float) -> pa.Table:
        if self.process is None:
            context = multiprocessing.get_context("fork")
            self.pipe, other = context.Pipe()
            self.process = context.Process(target=self._serve, args=(other,), daemon=True)
            self.process.start()
            other.close()
            self.pipe.recv_bytes()  # the script's time begins when its process runs
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        self.pipe.send_bytes(sink.getvalue().to_pybytes())
        if not self.pipe.poll(seconds):
            self.close()
            raise ScriptError(f"TimeoutError: script timed out after {seconds} seconds")
        try:
            found = self.pipe.recv_bytes()
        except EOFError:
            self.close()
            raise ScriptError("ProcessError: the script ended its process") from None
        if found[:1] == b"-":
            raise ScriptError(found[1:].decode())
        return pa.ipc.open_stream(found[1:]).read_all()

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


class ScriptError(Exception):
    """What a script raised, or that it took too long."""


@contextmanager
def runner(fn: Callable, flavour: str, timeout: float | None) -> Iterator[Callable[[pa.RecordBatch], pa.Table]]:
    """Applies a script to a batch: in this process, or with a timeout in a child that ends at the deadline."""
    if not timeout:
        def direct(batch: pa.RecordBatch) -> pa.Table:
            try:
                return _apply(fn, flavour, batch)
            except Exception as e:  # noqa: BLE001  the script is the user's
                raise ScriptError(f"{type(e).__name__}: {e}") from e

        yield direct
        return
    child = Child(fn, flavour)
    try:
        yield lambda batch: child.apply(batch, timeout)
    finally:
        child.close()


def _apply(fn: Callable, flavour: str, batch: pa.RecordBatch) -> pa.Table:
    if flavour == "pandas":
        return pa.Table.from_pandas(fn(batch.to_pandas()), preserve_index=False)
    if flavour == "polars":
        import polars  # where it is installed

        return fn(polars.from_arrow(pa.Table.from_batches([batch]))).to_arrow()
    if flavour == "records":
        return pa.Table.from_pylist(fn(batch.to_pylist()))
    out = fn(batch)
    return out if isinstance(out, pa.Table) else pa.Table.from_batches([out])


def run(df: DataFrame, fn: Callable, flavour: str, schema: T.StructType | str, timeout: float | None = None) -> DataFrame:
    """The batches of df through a function; a failing batch, or one that takes longer than timeout seconds, fails the job.

    Each batch is on its own and of bounded size.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with runner(fn, flavour, timeout) as apply:
            for batch in source:
                yield from apply(batch).select(arrow.names).cast(arrow).to_batches()

    return df.mapInArrow(batches, kind)


def run_isolated(df: DataFrame, fn: Callable, flavour: str, schema: T.StructType | str, timeout: float | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Good output rows; and dead rows (row_payload, error). A failing batch is halved until the failing rows stand alone.

    Each run of the script has timeout seconds, so a row that never ends costs as many as the batch can be halved. Both results come
    from one tagged output, which keep may store; without, the script runs for each of them.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    tagged = T.StructType([T.StructField("row", kind), T.StructField("row_payload", T.StringType()), T.StructField("error", T.StringType())])
    arrow, out_schema = to_arrow_schema(kind), to_arrow_schema(tagged)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with runner(fn, flavour, timeout) as apply:
            for batch in source:
                done, dead, stack = [], [], [batch] if len(batch) else []
                while stack:
                    part = stack.pop()
                    try:
                        done += apply(part).select(arrow.names).cast(arrow).to_pylist()
                    except Exception as e:  # noqa: BLE001  the script is the user's, and so is what it returns
                        if len(part) > 1:
                            stack += [part.slice(len(part) // 2), part.slice(0, len(part) // 2)]
                        else:
                            error = str(e) if isinstance(e, ScriptError) else f"{type(e).__name__}: {e}"
                            dead.append({"row": None, "row_payload": json.dumps(part.to_pylist()[0], default=str), "error": error})
                yield pa.RecordBatch.from_pylist([{"row": r, "row_payload": None, "error": None} for r in done] + dead, out_schema)

    out = keep(df.mapInArrow(batches, tagged))
    return out.filter("error is null").select("row.*"), out.filter("error is not null").select("row_payload", "error")


def dry_run(df: DataFrame, code: str, rows: int = 10) -> dict:
    """What a script makes of a few rows: flavour, schema and sample, or the error."""
    try:
        fn, flavour = compiled(code)
        out = _apply(fn, flavour, df.limit(rows).toArrow().combine_chunks().to_batches()[0])
    except Exception as e:  # noqa: BLE001
        return {"valid": False, "error": f"{type(e).__name__}: {e}"}
    return {"valid": True, "flavour": flavour, "schema": from_arrow_schema(out.schema), "sample": out.to_pylist()}


class Plugins:
    """Named batch functions, each with the schema that it returns."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable, T.StructType | str]] = {}

    def load(self, name: str, fn: Callable, schema: T.StructType | str) -> None:
        self._known[name] = (fn, schema)

    def unload(self, name: str) -> None:
        self._known.pop(name, None)

    def execute(self, name: str, df: DataFrame) -> DataFrame:
        fn, schema = self._known[name]
        return run(df, fn, "arrow", schema)


def python_expression(df: DataFrame, target: str, fn: Callable[[dict], object]) -> DataFrame:
    """A text column from a Python function of the row, for what SQL cannot say; an Arrow batch at a time.

    Lists and dicts become JSON text; an error gives the text of the row.
    """

    def value(row: dict) -> str | None:
        try:
            out = fn(row)
        except Exception:  # noqa: BLE001
            return json.dumps(row, default=str)
        return json.dumps(out, default=str) if isinstance(out, (dict, list)) else None if out is None else str(out)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([value(r) for r in batch.to_pylist()], pa.string())], [*batch.schema.names, target])

    return df.mapInArrow(batches, T.StructType([*df.schema, T.StructField(target, T.StringType())]))

