"""The rank map's arrays are in a plan once, however often the fold reads them."""

from pyspark.sql import functions as F

from hindcast.llm import bpe


def test_fold_names_the_rank_arrays_once(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    rank_map = bpe.RankMap(ranks)
    folded = bpe.fold_merges(F.col("word"), rank_map)
    assert str(folded._jc.toString()).count(",".join(map(str, rank_map.entries.tolist()))) == 1
    words = spark.createDataFrame([([97, 98, 99],), ([97] * 50 + [98],), ([97],)], "word array<int>")
    assert [r[0] for r in words.select(folded.alias("ids")).collect()] == [[257], [97] * 49 + [256], [97]]
