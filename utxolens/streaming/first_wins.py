"""First-wins deduplication of a stream by keyed state that outlives restarts.

The state of a key is the digest of the row that won. Rows that come later, in this run or after a stop, are duplicates if
their digest is the same, else conflicting variants. Keys are dealt into buckets and a bucket's winners are one state, so that Python
is entered once a bucket and trigger, not once a key. Within one micro-batch the row first in source order wins; there new keys' rows
are held as (ordinal, key, digest) only, so a trigger's size bounds what a task holds. Once a key is known its rows pass through.

Defined results: rows without a key get no verdict and pass as 'accepted'; a null digest is one like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Buckets of keys; a checkpoint keeps the number it began with.
BUCKETS = 4096

_VERDICTS = "logical_record long, key string, verdict string"


def _judge(bucket, chunks, state: GroupState):
    import pandas as pd

    def verdicts(rows, digest, first=None):
        out = (rows["digest"] == digest).map({True: "duplicate", False: "conflicting variant"})
        out[rows["key"].isna() if first is None else rows["logical_record"] == first] = "accepted"
        return pd.DataFrame({"logical_record": rows["logical_record"], "key": rows["key"], "verdict": out})

    keys, digests = (list(x) for x in state.get) if state.exists else ([], [])
    known, fresh = dict(zip(keys, digests)), []
    for rows in chunks:
        digest = rows["key"].map(known)
        ready = digest.notna() | rows["key"].isna()
        if ready.any():
            yield verdicts(rows[ready], digest[ready])
        fresh.append(rows.loc[~ready, ["logical_record", "key", "digest"]])
    rows = pd.concat(fresh, ignore_index=True)
    if len(rows):
        first = rows.sort_values("logical_record", kind="stable").drop_duplicates("key").set_index("key")
        state.update((keys + first.index.tolist(), digests + first["digest"].tolist()))
        yield verdicts(rows, rows["key"].map(first["digest"]), rows["key"].map(first["logical_record"]))


def first_wins_verdicts(rows: DataFrame, key: str, digest, ordinal: str = "logical_record") -> DataFrame:
    """(logical_record, key, verdict) of a stream's rows: accepted, duplicate or conflicting variant."""
    slim = rows.select(F.col(ordinal).cast("long").alias("logical_record"), F.col(key).cast("string").alias("key"), F.coalesce(digest.cast("string"), F.lit("")).alias("digest"))
    # Rows without a key are spread by their place.
    bucket = F.pmod(F.xxhash64(F.coalesce("key", F.col("logical_record").cast("string"))), F.lit(BUCKETS))
    return slim.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_judge, _VERDICTS, "keys array<string>, digests array<string>", "append", GroupStateTimeout.NoTimeout)
