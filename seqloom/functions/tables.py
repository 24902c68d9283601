"""Table functions for SQL: `SELECT * FROM word_search(TABLE(targets), 'STEEL')`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="seq_id bigint, bits double")
class WordSearch:
    """Ungapped bit scores of the rows of a table (seq_id, seq) against a model of one word; rows are gathered into batches."""

    def __init__(self):
        self.rows, self.word = [], None

    def _scores(self):
        import numpy as np

        from seqloom.functions.alphabet import digitize
        from seqloom.operators import kernels as K
        from seqloom.operators import profile as P

        p = P.configure(P.single_sequence("word", self.word))
        codes = [digitize(s) for _, s in self.rows]
        n = np.array([len(c) for c in codes], float)
        bits = (K.msv_many([p], codes)[:, 0] - (n * np.log(n / (n + 1)) + np.log(1 / (n + 1)))) / np.log(2)
        out = [(k, float(b)) for (k, _), b in zip(self.rows, bits, strict=True)]
        self.rows = []
        return out

    def eval(self, row, word: str):
        self.word = word
        if row["seq"]:
            self.rows.append((row["seq_id"], row["seq"]))
        if len(self.rows) >= 1000:
            yield from self._scores()

    def terminate(self):
        if self.rows:
            yield from self._scores()


def register(spark: SparkSession) -> None:
    spark.udtf.register("word_search", WordSearch)
