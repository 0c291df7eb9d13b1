"""Join helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import BROADCAST_ROWS, is_small

SALTS = 64


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS,
           salts: int = SALTS) -> DataFrame:
    """Join a per-key table to a large one whose keys may be hot.

    ``small`` has one row per key and should be cheap to read twice. Counted within ``max_rows`` it is broadcast, so
    the large side is not moved. Beyond that every key is spread over ``salts`` tasks: the small side is repeated
    once per salt, the large side gets one salt per row.
    """
    if is_small(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a salt from the row's own content is the same when a lost task is run again
    hashable = [f.name for f in big.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")
