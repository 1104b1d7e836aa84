import pytest

from spantrack.llm.bpe import Bpe, read_ranks, vocabulary_path

tiktoken = pytest.importorskip("tiktoken")
TEXTS = [None, "", " ", "\n\n  a", "Hello world, it's 12.5% ...", "naïve café — Straße", "Старая мельница измерила", "漢字かな交じり文。", "ภาษาไทย ต่าง ๆ", "🎩🎩 ��41�", "a b c　 d",
         "x" * 300, "<|endoftext|> [MASK]", "don't we'll I'D", "tab\tand\r\nbreaks \n ", "मालियों ने बाज़ार", "لجنة الميناء", "​́", "a  b   c    ", "ﬁ½²Ⅷ", "word " * 3000,
         "ฟ้ามืดครึ้มแม่น้ำไหลเชี่ยวผู้คนรีบกลับบ้านก่อนฝนตก" * 20, "旧磨坊在铁路旁边修理了石桥又打开了下层仓库" * 20, "aGVsbG8gd29ybGQK" * 60, "abcab" * 80, "tHeQuIcKbRoWnFoX" * 40, "0123456789" * 50]


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(vocabulary_path()), special_tokens={})


@pytest.mark.parametrize("hot", [1, 1000])
def test_ids_and_round_trip(spark, encoder, hot):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 2)]
    bpe = Bpe()
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id int, text string, w string"), "text", hot=hot)
    from pyspark.sql import functions as F

    got = {r["doc_id"]: (r["ids"], r["back"]) for r in coded.select("doc_id", "ids", bpe.decode(F.col("ids")).alias("back")).collect()}
    for i, t, _ in rows:
        assert got[i] == (encoder.encode_ordinary(t or ""), t or "")


def test_long_words_take_linear_time(spark):
    """Text without blanks: ten times the length takes far less than a hundred times as long."""
    import random
    import time

    from pyspark.sql import functions as F

    rng, took = random.Random(1), []
    letters = "ฟ้ามืดครึ้มแม่น้ำไหลเชี่ยวผู้คนรีบกลับบ้านก่อนตก旧磨坊在铁路旁边修理了石桥"
    bpe = Bpe()
    for n in (2_000, 2_000, 20_000):
        df = spark.createDataFrame([("".join(rng.choices(letters, k=n)),)], "text string")
        began = time.time()
        bpe.encode(df, "text", hot=1).select(F.size("ids")).collect()
        took.append(time.time() - began)
    assert took[2] < 40 * took[1]


def test_ids_cut_amid_a_character_decode(spark):
    from pyspark.sql import functions as F

    bpe = Bpe()
    row = bpe.encode(spark.createDataFrame([("🎩",)], "text string"), "text").select("ids", bpe.decode(F.slice("ids", 1, 1)).alias("part"), bpe.decode(F.lit(None).cast("array<int>")).alias("none")).first()
    assert len(row["ids"]) > 1 and set(row["part"]) == {"\ufffd"} and row["none"] is None


def test_empty_table(spark):
    assert Bpe().encode(spark.createDataFrame([], "text string"), "text").count() == 0
