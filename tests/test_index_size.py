"""What an index writes: only the postings that are asked for, many in a row."""

from loomsearch.operators.index import SearchIndex
from loomsearch.operators.search import word_hits


def test_an_index_of_words_has_no_grams_and_few_rows(spark, tmp_path):
    m = spark.createDataFrame([(k, f"the barn w{k % 7} the") for k in range(400)], "mid long, content string").coalesce(2)
    index = SearchIndex(spark, str(tmp_path / "i"), stems=False, kinds=("words",)).add(m)
    assert not (tmp_path / "i" / "grams").exists()
    assert spark.read.parquet(f"{index.path}/words").count() <= 2 * 9
    want = sorted((r["mid"], round(r["score"], 9)) for r in word_hits(m, '"the barn"', stems=False).collect())
    assert len(want) == 400 and sorted((r["mid"], round(r["score"], 9)) for r in index.word_hits('"the barn"').collect()) == want
