import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqtables.operators import features


def test_hashes_of_kmers_and_their_averages():
    for text in ("", "AB", "ABCABCZ", "AéBCD", "Q" * 500):
        for k in (1, 3, 5):
            codes = [zlib.crc32(text[i : i + k].encode()) for i in range(len(text) - k + 1)]
            assert features.kmer_hashes(text, k).tolist() == codes
            want = np.zeros(8)
            for code in codes:
                want[code % 8] += 1 if code >> 16 & 1 else -1
            assert np.allclose(features.hash_encoder(8, k)([text])[0], want / max(len(codes), 1))


def test_encoded_rows_go_out_together(spark):
    # a table of many short batches is not a frame per batch
    df = spark.range(2000).select("id", F.expr("repeat('ABCDE', cast(id % 7 as int))").alias("seq")).coalesce(1)
    made = []
    frames = pd.DataFrame({"id": range(2000), "seq": ["ABCDE" * (i % 7) for i in range(2000)]})

    class Rows:
        schema = df.schema
        where = select = lambda self, *a: self
        mapInPandas = lambda self, run, kind: made.extend(run(iter([frames])))

    features.encode(Rows(), features.hash_encoder(4), budget=5)
    assert len(made) <= 3 and sum(map(len, made)) == 2000
    rows = {r.id: r for r in features.encode(df, features.hash_encoder(4), budget=5).collect()}
    assert len(rows) == 2000 and all(np.allclose(rows[i].features, features.hash_encoder(4)(["ABCDE" * (i % 7)])[0]) for i in range(2000))
