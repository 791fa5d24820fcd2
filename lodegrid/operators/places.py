"""Lines of offsets: each file's line starts are found once, every offset is then looked up by bisection."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NEWLINE = re.compile("\n")
PLACES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("window", T.StringType())]))


def places_in(text: str | None, offsets, before: int = 1, after: int = 8) -> list[dict]:
    """Line (from 1) and window of lines for each 0-based offset; an offset outside the text counts as its nearer end.

    The window reaches from `before` lines above the offset's line to `after` lines on, counting that line. Lines end at line feeds; what
    follows a last line feed is a line only if it is not empty.
    """
    text = text or ""
    starts = [0, *(m.end() for m in _NEWLINE.finditer(text))]
    lines = len(starts) - (starts[-1] == len(text))
    out = []
    for o in offsets if offsets is not None else ():
        ln = bisect.bisect_right(starts, min(max(int(o), 0), len(text))) - 1
        lo, hi = max(0, ln - before), min(lines, ln + after)
        end = starts[hi] - 1 if hi < len(starts) else len(text)
        out.append({"start": int(o), "line": ln + 1, "window": text[starts[lo] : max(starts[lo], end)] if lo < hi else ""})
    return out


@F.pandas_udf(PLACES)
def _places(text: pd.Series, offsets: pd.Series) -> pd.Series:
    return pd.Series([places_in(t, o) for t, o in zip(text, offsets)])


def with_lines(hits: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("target_id", "path"), text: str = "raw") -> DataFrame:
    """hits(keys, start, ...) with `line` and `window` of the file that the keys name.

    The distinct offsets of a file travel to its text as one list (at most as many as it has characters), and only line and window come
    back, so no text goes with a hit. Hits of a null offset or of a file that is not there keep null in both; files are one row a key.
    """
    hits = hits.drop("line", "window")
    asked = hits.where("start IS NOT NULL").groupBy(*keys).agg(F.collect_set(F.col("start").cast("long")).alias("__offsets"))
    found = files.select(*keys, F.col(text).alias("__text")).join(asked, list(keys)).select(*keys, F.explode(_places("__text", "__offsets")).alias("p"))
    return hits.join(found.select(*keys, F.col("p.start").alias("start"), "p.line", "p.window"), [*keys, "start"], "left")
