"""Scoring of a stream of transactions.

Search is row-local (broadcast references in Arrow batches), so no state and
no watermark are needed, and any source that gives JSON will do. Where the
references are too large to broadcast, each micro-batch runs the batch operator,
on references that were made ready once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintet.operators import knn, vectorize
from quintet.schema import THRESHOLD, TRANSACTION, K, Scale, struct
from quintet.session import cut


def requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """Transactions of JSON texts; what isn't one becomes null columns."""
    return raw.select(F.from_json(F.col(column).cast("string"), struct(TRANSACTION)).alias("r")).select("r.*")


def score(transactions: DataFrame, references: DataFrame | knn.Search, k: int = K, threshold: float = THRESHOLD, scale: Scale | None = None, risk: dict[str, float] | None = None, most_bytes: int = knn.MOST_BYTES) -> DataFrame:
    """(id, fraud_score, approved) of a batch or stream of transactions.

    The references' distinct vectors have to fit a broadcast; a search that is
    made already may be given in their place, with its own k.
    """
    search = references if isinstance(references, knn.Search) else knn.Search(references, k, most_bytes=most_bytes)
    if not search.sent:
        raise ValueError(f"distinct references take more than {most_bytes} bytes; score each micro-batch with score_batches")
    sent, k = search.sent, search.k

    def run(batches):
        known = sent.value
        fraud = np.append(np.array(known.names.to_pylist(), object) == "fraud", False)
        for b in batches:
            if not b.num_rows:
                continue
            there, q = knn.matrix(b.column("vector"))
            votes = np.zeros(b.num_rows, np.int64)
            votes[there] = fraud[known.nearest(q)[1]].sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.round(votes / k * 10000.0) / 10000.0), pa.array(votes / k < threshold)], names=["id", "fraud_score", "approved"])

    return vectorize.vectorize(transactions, scale, risk).mapInArrow(run, "id string, fraud_score double, approved boolean")


def scored(rows: DataFrame, search: knn.Search, threshold: float = THRESHOLD, scale: Scale | None = None, risk: dict[str, float] | None = None) -> DataFrame:
    """As score(), of a batch only, for references of any size."""
    if search.sent:
        return score(rows, search, threshold=threshold, scale=scale, risk=risk)
    queries = cut(rows.select(F.monotonically_increasing_id().alias("q_id"), "id", vectorize.vector(scale, risk).alias("vector")))
    votes = knn.counted(search.nearest(queries), search.k, threshold)
    return queries.join(votes, "q_id").select("id", "fraud_score", "approved")


def score_batches(stream: DataFrame, references: DataFrame, write, checkpoint: str, **options):
    """A query that scores every micro-batch with the batch operator and hands it to write(rows, batch_id)."""
    search = knn.Search(references, first=knn.BUCKETS)

    def each(rows: DataFrame, batch_id: int) -> None:
        write(scored(rows, search), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).options(**options).start()
