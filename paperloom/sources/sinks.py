"""Sinks: upserts by partition, generations with a pointer, versioned artifacts, reports, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouped import per_group
from ..operators.relations import upserted


def _rewrite(spark: SparkSession, path: str, rows: DataFrame, touched: DataFrame, partition: str) -> None:
    """Puts ``rows`` in the place of the ``touched`` partitions; those left without rows go."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # partitions are few, rows are not: only the values that lost all of theirs come to the driver
    for value in [r[partition] for r in touched.join(rows.select(partition).distinct(), partition, "left_anti").collect()]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}"), True)


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], order: str, partition: str, semantic: Column | None = None) -> None:
    """Merges rows into a table at ``path``: the last of each key wins; only partitions with rows of these keys, old or new, are written (K1, K4).

    A key whose partition changes leaves none of its old rows behind. Rows without a key, and those that aren't ``semantic``, are skipped.
    """
    from ..session import materialise

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    valid = new.dropna(subset=list(keys))
    valid = valid if semantic is None else valid.where(F.coalesce(semantic, F.lit(False)))
    if not where.getFileSystem(conf).exists(where):
        upserted(valid.limit(0), valid, keys, order).write.partitionBy(partition).parquet(path)
        return
    table = spark.read.parquet(path)
    moved = table.join(valid.select(*keys).distinct(), list(keys), "left_semi").select(partition)
    touched = materialise(moved.unionByName(valid.select(partition)).distinct())
    rows = materialise(upserted(table.join(touched, partition, "left_semi"), valid, keys, order))
    _rewrite(spark, path, rows, touched, partition)


def delete_rows(spark: SparkSession, path: str, condition: str, partition: str) -> None:
    """Rewrites the partitions that hold rows meeting ``condition`` without these (K2)."""
    from ..session import materialise

    df = spark.read.parquet(path)
    hit = materialise(df.where(condition).select(partition).distinct())
    rest = materialise(df.join(hit, partition, "left_semi").where(f"not coalesce({condition}, false)"))
    _rewrite(spark, path, rest, hit, partition)


def scoped_id(ident: Column, scope: Sequence[Column], fallback: Column) -> Column:
    """A record's id: the one given, else one made of its tenant and natural key (K4)."""
    made = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in [*scope, fallback]]), 256)
    return F.coalesce(F.nullif(F.trim(ident.cast("string")), F.lit("")), made)


def write_generation(df: DataFrame, path: str, generation: str) -> None:
    """Writes a generation beside those that are there, then points to it, then drops the others (K3).

    The pointer is a file written aside and renamed, which no reader can see by half; there is always one: readers
    take the newest, and the older ones go only when the new one stands.
    """
    df.write.mode("overwrite").parquet(f"{path}/generation={generation}")
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = _pointers(spark, path)
    number = old[-1][0] + 1 if old else 1
    draft = path_of(f"{path}_active/.draft-{generation}")
    out = fs.create(draft, True)
    out.write(bytearray(generation.encode("utf8")))
    out.close()
    if not fs.rename(draft, path_of(f"{path}_active/{number:012d}")):
        raise RuntimeError(f"another generation was activated at {path}")
    for _, place in old:
        fs.delete(place, False)
    for s in fs.listStatus(path_of(path)):
        if s.getPath().getName() != f"generation={generation}":
            fs.delete(s.getPath(), True)


def _pointers(spark: SparkSession, path: str) -> list[tuple]:
    """The pointers of a table of generations, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}_active")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    return sorted(((int(s.getPath().getName()), s.getPath()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()), key=lambda x: x[0])


def read_active(spark: SparkSession, path: str) -> DataFrame:
    """The generation that the newest pointer names."""
    generation = spark.read.text(_pointers(spark, path)[-1][1].toString()).first()["value"]
    return spark.read.parquet(f"{path}/generation={generation}").withColumn("generation", F.lit(generation))


def artifact_path(base: str, *scope: str, step: str, version: int) -> str:
    """The place of a step's artifact: the same for the same scope, step and version (K5)."""
    return "/".join([base.rstrip("/"), *scope, f"{step}.v{version}"])


def write_artifact(df: DataFrame, base: str, *scope: str, step: str, version: int) -> str:
    """Writes JSON to an artifact's place."""
    path = artifact_path(base, *scope, step=step, version=version)
    df.write.mode("overwrite").json(path)
    return path


def write_reports(df: DataFrame, base: str, title: str = "Report") -> dict[str, str]:
    """A report as JSON lines, as CSV with a header and as an HTML page, each one file (K7); a report is small by nature."""
    df.coalesce(1).write.mode("overwrite").json(f"{base}/json")
    flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema])
    flat.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{base}/csv")
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda tag, cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))
    spark = df.sparkSession
    head = spark.range(1).select(F.concat(safe(F.lit(title)), F.lit("<table>")).alias("t"), row("th", [safe(F.lit(c)) for c in flat.columns]).alias("h")).select(F.explode(F.array(F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), F.replace("t", F.lit("<table>"), F.lit("</title><table>"))), F.col("h"))).alias("value"))
    body = flat.select(row("td", [safe(F.col(c)) for c in flat.columns]).alias("value"))
    lines = head.withColumn("_o", F.lit(0)).unionByName(body.withColumn("_o", F.lit(1))).unionByName(spark.range(1).select(F.lit("</table>").alias("value"), F.lit(2).alias("_o")))
    lines.coalesce(1).sortWithinPartitions("_o").select("value").write.mode("overwrite").text(f"{base}/html")
    return {kind: f"{base}/{kind}" for kind in ("json", "csv", "html")}


def throttled(df: DataFrame, key: str, ts: str, ident: str, forced: str, seconds: float) -> DataFrame:
    """The states that are written if a key's are at least ``seconds`` apart from the last one written, or forced (K6).

    The first is written, then the next one ``seconds`` or more behind the last written; a forced one is always, and counts as a write.
    One key's states are a job's; ties go by ``ident``.
    """
    kind = df.schema[ident].dataType.simpleString()

    def run(rows: list[dict]) -> list[tuple]:
        last, out = None, []
        for r in rows:
            if r["_f"] or last is None or r["_t"] - last >= seconds:
                last = r["_t"]
                out.append((r[ident],))
        return out

    states = df.select(key, F.col(ts).cast("timestamp").cast("double").alias("_t"), ident, F.coalesce(forced, F.lit(False)).alias("_f")).where("_t is not null")
    kept = per_group(states, [key], ["_t", ident], run, f"_kept {kind}").select(F.col(key).alias("_key"), "_kept")
    return df.join(kept, df[key].eqNullSafe(F.col("_key")) & (df[ident] == F.col("_kept")), "left_semi")


def sliced(df: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Rows ``(*keys, pages, text)``: a slot's pages in order as one document."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return df.groupBy(*keys).agg(rows.alias("_r")).select(*keys, F.size("_r").alias("pages"), F.array_join(F.transform("_r", lambda x: x["t"]), "\f").alias("text"))
