"""Reports: one JSON object or CSV line per file, with fixed decimals; what wasn't measured is null or an empty cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = {"integrated": 3, "lra": 3, "max_short_term": 3, "max_momentary": 3, "true_peak_db": 3, "sample_peak_db": 3, "rms_db": 3, "crest_db": 3, "dc_offset": 6, "correlation": 4, "seconds": 3, "dcOffset": 6, "stereoCorrelation": 4}


def fixed(df: DataFrame) -> DataFrame:
    """Doubles as C's ``printf`` writes them, rounded by their exact value; ``seconds`` with halves of the shortest decimal up, as ``format_string`` does."""

    @F.pandas_udf("string")
    def written(v: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(["%.*f" % (p, x) for x, p in zip(v, places)], dtype=object)

    cell = lambda c: F.format_string(f"%.{PLACES[c]}f", F.col(c)) if c == "seconds" else written(F.col(c), F.lit(PLACES.get(c, 3)))
    return df.select(*(F.when(F.col(c).isNotNull(), cell(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def csv_lines(df: DataFrame) -> DataFrame:
    """``line`` per row; text cells with quotes, commas or breaks are quoted with doubled quotes."""
    quote = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    f = fixed(df)
    return f.select(F.array_join(F.array(*(F.coalesce(quote(F.col(c).cast("string")), F.lit("")) for c in f.columns)), ",").alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    numbers = df.select(*(F.round(c, PLACES.get(c, 3)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    return numbers.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
