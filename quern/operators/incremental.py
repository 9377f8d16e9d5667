"""Incremental maintenance: what changed, what goes, delta edges, caches, fingerprints, privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quern.operators import graph as G


def changed(current: DataFrame, state: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``current`` that are new or whose hash differs, or whose artifacts are incomplete.

    ``state(path, sha256, complete)`` is what the last run left.
    """
    old = state.select(key, F.col("sha256").alias("old_sha"), "complete")
    j = current.join(old, key, "left")
    same = F.col("sha256").eqNullSafe(F.col("old_sha")) & F.coalesce("complete", F.lit(False))
    status = F.when(F.col("old_sha").isNull(), "new").when(F.col("sha256") != F.col("old_sha"), "changed").otherwise("incomplete")
    return j.where(~same).withColumn("status", status).drop("old_sha", "complete")


def changed_since(files: DataFrame, since_ms: int) -> DataFrame:
    """Files whose modification time is not before ``since_ms``; the filter reaches the scan."""
    return files.where(F.col("mtime_ms") >= since_ms)


def select_run(files: DataFrame, state: DataFrame, since_ms: int | None = None, diff: DataFrame | None = None) -> DataFrame:
    """The files of a run: all, those since a time, or those of a commit diff; never two of them.

    With a diff, files that the state calls incomplete come along.
    """
    if since_ms is not None and diff is not None:
        raise ValueError("choose a time or a commit, not both")
    if since_ms is not None:
        return changed_since(files, since_ms)
    if diff is not None:
        wanted = diff.select("path").union(state.where(~F.col("complete")).select("path")).distinct()
        return files.join(wanted, "path", "left_semi")
    return files


def pruned(state: DataFrame, present: DataFrame, failed: DataFrame, failed_prefixes: list[str] | DataFrame, allowed: Column | None = None, git_deleted: DataFrame | None = None) -> DataFrame:
    """Paths to delete: out of scope; else deleted by the commit, or gone and not failed to read.

    ``failed_prefixes`` are the folders that could not be walked, a list or ``(prefix)`` rows;
    what the state has below them stays.
    """
    out_of_scope = state.where(~allowed).select("path") if allowed is not None else state.select("path").where("false")
    if git_deleted is not None:
        gone = state.join(git_deleted.select("path").distinct(), "path", "left_semi").select("path")
    else:
        gone = state.select("path").join(present.select("path"), "path", "left_anti").join(failed.select("path"), "path", "left_anti")
        if isinstance(failed_prefixes, DataFrame):
            kept = F.broadcast(failed_prefixes.where("prefix is not null").select("prefix").distinct())  # folders that failed: few, or the run is void
            gone = gone.join(kept, F.startswith(gone["path"], kept["prefix"]), "left_anti")
        else:
            for p in failed_prefixes:
                gone = gone.where(~F.startswith("path", F.lit(p)))
    return out_of_scope.union(gone).distinct()


def delta_edges(old: DataFrame, refs: DataFrame, symbols: DataFrame, old_symbols: DataFrame, dirty: DataFrame) -> DataFrame:
    """Edges after a change, rebuilding only those at affected files.

    Affected are the dirty files, and the files that refer to a name a dirty file
    defines or used to define. The result equals a full rebuild.
    """
    d = dirty.select("path").distinct()
    names = symbols.join(d, "path", "left_semi").select("name").union(old_symbols.join(d, "path", "left_semi").select("name")).distinct()
    touched = refs.join(names.select(F.col("name").alias("symbol")), "symbol", "left_semi").select("path").union(d).distinct()
    kept = old.join(touched.select(F.col("path").alias("src")), "src", "left_anti")
    kept = kept.select(*old.columns)
    again = G.edges_ref_exact(refs.join(touched, "path", "left_semi"), symbols)
    return kept.unionByName(again)


def cached_vectors(chunks: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """``chunks`` with ``vector`` and ``cache_state``: hit, miss or corrupt, by hash and model."""
    own = cache.where(F.col("model") == model).select("chunk_hash", "vector")
    j = chunks.join(own, "chunk_hash", "left")
    bad = (F.size("vector") != dim) | F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    state = F.when(F.col("vector").isNull(), "miss").when(bad, "corrupt").otherwise("hit")
    return j.withColumn("cache_state", state).withColumn("vector", F.when(F.col("cache_state") == "hit", F.col("vector")))


def sorted_digest(rows: DataFrame, key: str, item: str, between: str) -> DataFrame:
    """``(key, n_rows, fingerprint)``: SHA-256 of a key's items in order, joined by ``between``.

    A key's rows lie in one task, sorted, and go through the hash as a stream, so none is gathered, however many it has.
    """
    rows = rows.select(F.col(key), F.col(item).alias("item")).repartition(key).sortWithinPartitions(key, "item")
    kind = rows.schema[key].dataType.simpleString()

    def digests(batches):
        import hashlib
        from itertools import groupby

        import pyarrow as pa

        now, h, n, done = None, None, 0, []

        def flush():
            nonlocal done
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], of), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], [key, "n_rows", "fingerprint"])
            done = []
            return out

        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            for k, run in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda r: r[0]):
                items = [r[1] for r in run]
                if h is not None and k == now:
                    h.update((between + between.join(items)).encode())
                    n += len(items)
                    continue
                if h is not None:
                    done.append((now, n, h.hexdigest()))
                now, h, n = k, hashlib.sha256(between.join(items).encode()), len(items)
            if len(done) >= 10_000:
                yield flush()
        if h is not None:
            done.append((now, n, h.hexdigest()))
        if done:
            yield flush()

    return rows.mapInArrow(digests, f"`{key}` {kind}, n_rows long, fingerprint string")


def _line(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def fingerprint(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """``(key, n_rows, fingerprint)``: a digest of a key's rows that does not depend on their order."""
    return sorted_digest(rows.select(key, F.sha2(_line(columns), 256).alias("e")), key, "e", "")


def verify_artifacts(stored: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """``(key, state, complete)`` of every key that is stored or present.

    ``stored(key, n_rows, fingerprint)`` is what was written down, ``actual`` what
    :func:`fingerprint` finds: ok, count_differs, content_differs, missing (nothing there) or
    unrecorded (nothing written down). Only ok ones are complete; the others are to be made again.
    """
    s = stored.select(key, F.col("n_rows").alias("s_n"), F.col("fingerprint").alias("s_f"))
    j = s.join(actual.select(key, "n_rows", "fingerprint"), key, "full")
    state = (
        F.when(F.col("n_rows").isNull() & (F.col("s_n") > 0), "missing").when(F.col("s_n").isNull(), "unrecorded").when(F.coalesce("n_rows", F.lit(0)) != F.col("s_n"), "count_differs")
        .when(F.coalesce("fingerprint", "s_f") != F.col("s_f"), "content_differs").otherwise("ok")
    )
    return j.select(key, state.alias("state"), (state == "ok").alias("complete"))


def compatible(meta: dict, want: dict) -> list[str]:
    """The settings in which a stored index differs from what this run needs."""
    return [k for k in ("format", "model", "dim", "ann_version") if str(meta.get(k)) != str(want.get(k))]


# --- fixed values: fields that privacy modes rewrite ------------------------------------
PRIVATE_FIELDS = ("path", "preview", "excerpt", "text", "query", "symbol", "sample")


def private(value: Column, mode: str) -> Column:
    """A string as it is, masked but for its extension, or hashed."""
    if mode == "off":
        return value
    if mode == "hash":
        return F.when(value.isNull(), value).otherwise(F.concat(F.lit("h:"), F.substring(F.sha2(value, 256), 1, 16)))
    return F.when(value.isNull(), value).otherwise(F.concat(F.lit("***"), F.regexp_extract(value, r"(\.[A-Za-z0-9]{1,8})?$", 1)))


def project_private(df: DataFrame, mode: str, fields: tuple[str, ...] = PRIVATE_FIELDS) -> DataFrame:
    """``df`` with the named string fields rewritten at any depth of structs and arrays."""

    def walk(col: Column, kind: ST.DataType, name: str) -> Column:
        if isinstance(kind, ST.StructType):
            inner = F.struct(*[walk(col[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields])
            return F.when(col.isNull(), F.lit(None)).otherwise(inner)
        if isinstance(kind, ST.ArrayType):
            return F.transform(col, lambda x: walk(x, kind.elementType, name))
        return private(col, mode) if isinstance(kind, ST.StringType) and name in fields else col

    return df.select(*[walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def prune_old(rows: DataFrame, column: str, days: int = 15) -> DataFrame:
    """Rows of a cache that were used in the last ``days`` days."""
    return rows.where(F.col(column) >= F.date_sub(F.current_date(), days))
