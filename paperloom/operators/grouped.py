"""Sequential work on small groups, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows ``(*keys, schema)`` that ``fn`` makes of each group's rows, given in order as dicts.

    A group is one array, built by a partial aggregation; a Python worker takes thousands of
    groups a batch, which costs a hundredth of a pandas frame for each. Meant for groups that
    the data bound: the words of a page, the pages of a filing.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [F.col(c) for c in order] + [F.col(c) for c in rest if c not in order]
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*first))).alias("_rows"))
    out = StructType([*df.select(*keys).schema.fields, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [batch.column(i).to_pylist() for i in range(len(keys))]
            made = [(*k, *r) for *k, group in zip(*heads, batch.column(len(keys)).to_pylist()) for r in fn(group)]
            cols = list(zip(*made)) if made else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return rows.mapInArrow(run, out)
