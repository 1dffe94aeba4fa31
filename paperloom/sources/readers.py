"""Sources: files, JSON and JSONL, binary documents, catalogues, queues, saved artifacts."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def allowed_urls(urls: DataFrame, url: str, hosts: DataFrame, host: str = "host", scheme: str = "https") -> DataFrame:
    """The rows whose URL has the scheme and a host of the list, or one below it, and isn't a bare address."""
    h = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    parts = F.split(h, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = urls.withColumn("_h", h).where((F.lower(F.try_parse_url(F.col(url), F.lit("PROTOCOL"))) == scheme) & F.col("_h").isNotNull() & ~F.col("_h").rlike(r"^[\d.]+$|:"))
    hit = known.withColumn("_e", F.explode(ends)).join(hosts.select(F.lower(host).alias("_e")).distinct(), "_e", "left_semi")
    return hit.drop("_h", "_e").distinct()


def public_address(address: str) -> bool:
    """Whether an address may be fetched: not private, local, reserved or of a link."""
    try:
        return ipaddress.ip_address(address).is_global
    except ValueError:
        return False


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf", most: int = 50 * 2**20) -> DataFrame:
    """Rows ``(path, name, length, content)`` of files by pattern, larger ones left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def pages_by(documents: DataFrame, provider: Callable[[bytes], list[dict]], schema: str, keep: Sequence[str] = ("path",)) -> DataFrame:
    """What ``provider`` (a parser, reader of layouts or OCR) makes of each document's bytes, a row per page."""
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*k, *(page.get(n) for n in names)) for *k, content in zip(*(pdf[c] for c in keep), pdf["content"]) for page in provider(bytes(content))]
            yield pd.DataFrame(out, columns=[*keep, *names])

    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, "content").mapInPandas(run, f"{kinds}, {schema}")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a schema; lines that are no JSON objects are skipped."""
    text = spark.read.text(path)
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return text.where(F.trim("value").startswith("{") & F.expr("try_parse_json(value)").isNotNull()).select(row.alias("_r")).where("_r is not null").select("_r.*")


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON document, or several, of many lines each."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def first_existing(spark: SparkSession, paths: Sequence[str], schema: str, multi_line: bool = True) -> DataFrame:
    """The JSON of the first path that is there; an empty table of the schema if none is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return spark.read.schema(schema).option("multiLine", multi_line).json(p)
    return spark.createDataFrame([], schema)


def database_table(spark: SparkSession, url: str, name: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table by JDBC, in ``parts`` ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition:
        reader = reader.option("partitionColumn", partition).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def parsed_items(df: DataFrame, payload: str, keep: Sequence[str], drop: Sequence[str] = ("html", "csv")) -> DataFrame:
    """Rows ``(*keep, page, item_index, item)``: the items of a parse response's pages, without double renderings."""
    item = "map<string,string>"
    pages = F.from_json(payload, f"struct<pages:array<struct<page:int,items:array<{item}>>>>")
    rows = df.select(*keep, F.explode(pages["pages"]).alias("_p")).select(*keep, F.col("_p.page").alias("page"), F.posexplode("_p.items").alias("item_index", "_i"))
    return rows.select(*keep, "page", "item_index", F.map_filter("_i", lambda k, v: ~k.isin(*drop) & v.isNotNull()).alias("item"))


def int_keyed(df: DataFrame, mapping: str, keep: Sequence[str]) -> DataFrame:
    """Rows ``(*keep, page, value)`` of a map with page numbers as text; keys that are no numbers are left out."""
    rows = df.select(*keep, F.explode(F.map_entries(mapping)).alias("_e"))
    return rows.select(*keep, F.col("_e.key").try_cast("int").alias("page"), F.col("_e.value").alias("value")).where("page is not null")


def guarded_scan(df: DataFrame, most: int) -> DataFrame:
    """``df``; reading it fails if it has more than ``most`` rows."""
    n = df.agg(F.count("*").alias("_n"))
    fits = n.select(F.when(F.col("_n") <= most, True).otherwise(F.raise_error(F.lit(f"more than {most} rows")).cast("boolean")).alias("_ok"))
    return df.where(fits.scalar())


def at_most_one(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first row that meets a condition, with ``more``: whether there is another."""
    two = df.where(condition).orderBy(order).limit(2)
    return two.withColumn("more", F.count("*").over(_whole()) > 1).orderBy(order).limit(1)


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()


def verified(files: DataFrame, pinned: DataFrame, name: str = "name", checksum: str = "sha256") -> DataFrame:
    """The files whose content has the pinned sha-256."""
    return files.join(pinned.select(name, checksum), name).where(F.sha2("content", 256) == F.lower(checksum)).drop(checksum)


def queue_messages(stream: DataFrame, value: str, schema: str) -> DataFrame:
    """The messages of a queue's or topic's text column; what is no JSON is skipped (S17). Works on streams, too."""
    return stream.select(F.from_json(value, schema).alias("_m"), F.expr(f"try_parse_json({value})").alias("_j")).where("_m is not null and _j is not null").select("_m.*")


def allowed_chains(df: DataFrame, ident: str, hops: str, hosts: DataFrame, addresses: str | None = None) -> DataFrame:
    """Rows ``(ident, allowed, refused)``: whether a fetch may follow a chain of redirects: each hop must be allowed by itself, and each address public.

    ``refused`` is the first hop that isn't. ``addresses`` are those the hops resolved to; a chain without hops is refused.
    """
    steps = df.select(ident, F.posexplode_outer(hops).alias("_at", "_url"))
    fine = allowed_urls(steps.where("_url is not null"), "_url", hosts).select(ident, "_at", F.lit(True).alias("_ok"))
    told = steps.join(fine, [ident, "_at"], "left")
    per = told.groupBy(ident).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_all"), F.min(F.when(F.col("_ok").isNull(), F.struct("_at", "_url")))["_url"].alias("refused"))
    if addresses is None:
        return per.select(ident, F.col("_all").alias("allowed"), "refused")

    @F.pandas_udf("boolean")
    def public(column: pd.Series) -> pd.Series:
        return column.map(lambda xs: xs is not None and all(public_address(x) for x in xs))

    return per.join(df.select(ident, public(addresses).alias("_pub")), ident).select(ident, (F.col("_all") & F.col("_pub")).alias("allowed"), "refused")


def page_after(df: DataFrame, key: str, token, size: int) -> DataFrame:
    """The next ``size`` rows of a scan in order of ``key``, behind the ``token`` (null: from the beginning), with ``next``: the token to go on with, null at the end.

    The filter on the key reaches the source; a page and one row more is all that is sorted out.
    """
    from pyspark.sql import Window

    more = (df if token is None else df.where(F.col(key) > F.lit(token))).orderBy(key).limit(size + 1)
    n = F.row_number().over(Window.orderBy(key))
    rows = more.withColumn("_n", n).withColumn("_all", F.count("*").over(_whole()))
    last = F.max(F.when(F.col("_n") == size, F.col(key))).over(_whole())
    return rows.withColumn("next", F.when(F.col("_all") > size, last)).where(F.col("_n") <= size).drop("_n", "_all")


def revision(df: DataFrame, scope: list[str], version: str, columns: Sequence[str]) -> DataFrame:
    """Rows ``(*scope, rows, version, mark)``: a table's state per scope, to be compared with the one last read before it is read again.

    The mark changes if any row does, whatever the order: a sum of the rows' hashes.
    """
    return df.groupBy(*scope).agg(F.count("*").alias("rows"), F.max(version).alias("version"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("mark"))


def with_manifest(files: DataFrame, manifest: DataFrame, name: str = "name") -> DataFrame:
    """Rows ``(name, state)`` of a folder's files and a manifest's (S16): found, missing, unlisted; names compare without case."""
    f, m = files.select(F.lower(name).alias("_n"), F.col(name).alias("_a")).dropDuplicates(["_n"]), manifest.select(F.lower(name).alias("_n"), F.col(name).alias("_b")).dropDuplicates(["_n"])
    both = f.join(m, "_n", "full_outer")
    return both.select(F.coalesce("_b", "_a").alias("name"), F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unlisted").otherwise("found").alias("state"))
