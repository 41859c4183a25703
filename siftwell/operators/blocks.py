"""All rows against a stated table, in memory of a tile and a block: what no index can spare is compared in arrays, and only answers leave the task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.storage import written

#: Rows that meet a block of stated rows at once.
TILE, BLOCK = 2048, 1024
#: What a row of a weighed tile may weigh on average, and bytes of a group of rows in a file that tiles read in part.
EACH, GROUP = 320, 8 << 20


def weighed(batches: Iterable[pd.DataFrame], tile: int, weight: str, most: int) -> Iterator[pd.DataFrame]:
    """The rows of batches in order, in tiles of at most `tile` rows that weigh `most` at most; a row that weighs more is a tile."""
    held, rows, load = [], 0, 0
    for pdf in batches:
        while len(pdf):
            fits = int(np.searchsorted(load + np.cumsum(pdf[weight].to_numpy(), dtype="int64"), most, side="right"))
            fits = min(max(fits, int(not rows)), tile - rows, len(pdf))
            if fits:
                held.append(pdf.iloc[:fits])
                rows, load = rows + fits, load + int(held[-1][weight].sum())
                pdf = pdf.iloc[fits:]
            if len(pdf):
                yield pd.concat(held, ignore_index=True)
                held, rows, load = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def compared(rows: DataFrame, stated: DataFrame, answer: Callable[[pd.DataFrame, Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: StructType | str, by: list[str] | None = None, wide: int = 1, weight: str | None = None, only: Callable[[pd.DataFrame], ds.Expression] | None = None) -> DataFrame:
    """answer(tile, blocks) of every TILE rows of rows, where blocks are all rows of stated, BLOCK at a time, for as long as the answer asks for more.

    The stated table lies in the shared folder, and each task reads it block by block for each of its tiles. With `by`, columns of both, a tile reads only what has a value of its
    own in the first of them; both sides are dealt in ranges of all, so that a tile has few values and a value's rows stand in few files. Rows are dealt evenly, so that a small table is not one task's work.

    With `weight`, a column of numbers, tiles are of `wide` x TILE rows and of bounded weight, there are as many tasks as tiles, and rows are those of stated, which comes in ranges of `by`: only `by`, which tells
    them apart, and their weights are dealt, and a tile is read where the blocks are. `only` says which stated rows a tile reads of those.
    """
    spark = rows.sparkSession
    tasks = 3 * spark.sparkContext.defaultParallelism
    options = {"parquet.block.size": GROUP} if only else {}
    files = written(stated.repartitionByRange(tasks, *by).sortWithinPartitions(*by) if by and not weight else stated, "stated", **options).inputFiles()
    if not files:
        return spark.createDataFrame([], schema)
    folder, tile, block, most = files[0].rpartition("/")[0], wide * TILE, -(-BLOCK // wide), EACH * wide * TILE
    if weight:
        rows = spark.read.schema(stated.schema).parquet(folder).select(*dict.fromkeys([*by, weight]))
        tasks = max(tasks, -(-5 * rows.count() // (4 * tile)))  # ranges are found on a sample: few are larger than a tile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        # buffered ahead, a file would stay in memory as far as it was read
        table = ds.dataset(path, filesystem=store, format=ds.ParquetFileFormat(default_fragment_scan_options=ds.ParquetFragmentScanOptions(pre_buffer=False)))
        read = lambda kept: table.to_batches(filter=kept, batch_size=block, use_threads=False, batch_readahead=1, fragment_readahead=1)
        for part in weighed(batches, tile, weight, most) if weight else (pdf.iloc[low : low + tile] for pdf in batches for low in range(0, len(pdf), tile)):
            if weight:  # the last of by is looked up within the range that the others have
                within = [ds.field(c).isin(pa.array(part[c].unique(), table.schema.field(c).type)) for c in (by[0], by[-1])]
                within += [(ds.field(c) >= part[c].min().item()) & (ds.field(c) <= part[c].max().item()) for c in by[1:-1]]
                part = part[by].merge(pd.concat([b.to_pandas() for b in read(reduce(and_, within)) if len(b)]), on=by)
            kept = ds.field(by[0]).isin(part[by[0]].unique().tolist()) if by else None
            if only:
                kept = only(part) if kept is None else kept & only(part)
            yield from answer(part, (b.to_pandas() for b in read(kept) if len(b)))

    dealt = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by) if by else rows.repartition(tasks)
    return dealt.mapInPandas(run, schema)
