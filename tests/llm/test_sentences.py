import random

import numpy as np
import pytest

from spantrack.llm import sentences as S

SUBJECTS = ["The old mill", "A baker", "Our clerk", "The board", "Dr. Oror", "Mrs. Nerl", "Messrs. Fenro & Co. Ltd.", "K. K. Wexden"]
VERBS = ["opened", "sold", "painted", "welcomed", "refused"]
OBJECTS = ["the bridge", "two barrels", "the clock", "a petition", "12.5 miles of rope", "No. 20 on Jan. 4"]
MARK = "⏹"


def sentence(rng):
    x = f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)}"
    kind = rng.random()
    if kind < 0.08:
        return f'"{x}!" cried Mr. Hal.' + MARK
    if kind < 0.16:
        return f"Capt. Rog declared “{x}?”" + MARK
    if kind < 0.22:
        return f"The band (the ferry opened!) {rng.choice(VERBS)} the clock." + MARK
    if kind < 0.28:
        return f"The band … {rng.choice(VERBS)} the clock{rng.choice('.!?')}" + MARK
    return x + rng.choice("....!?") + MARK


def page(rng):
    blocks = ["TOWN NEWS" + MARK]
    for _ in range(rng.randrange(2, 6)):
        words = " ".join(sentence(rng) for _ in range(rng.randrange(1, 6))).split(" ")
        lines, line = [], ""
        for w in words:
            if len(line) + len(w) > 40:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        blocks.append("\n".join([*lines, line]))
    return "\n\n".join(blocks)


def split_marks(marked):
    text, ends = "", []
    for c in marked:
        if c == MARK:
            ends.append(len(text))
        else:
            text += c
    return text, ends


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    texts = [split_marks(page(rng))[0] for _ in range(600)]
    t = S.Text(texts)
    stats = S.Statistics.of(*S.Statistics.count(t, t.candidates()))
    return stats, S.fit(*S.features_of(texts, stats))


def test_held_out_accuracy(model):
    rng = random.Random(99)
    pages = [split_marks(page(rng)) for _ in range(200)]
    owner, ends = S.sentence_ends([p[0] for p in pages], *model)
    got = set(zip(owner.tolist(), ends.tolist()))
    want = {(i, e) for i, p in enumerate(pages) for e in p[1]}
    hit = len(got & want)
    assert hit / len(got) > 0.97 and hit / len(want) > 0.97


def ends_of(model, text):
    return S.sentence_ends([text], *model)[1].tolist()


def test_rules_that_always_hold(model):
    assert ends_of(model, "HEADING\n\nThe old mill sold\n") == [7, 26]
    assert ends_of(model, "HEADING\r\n\r\nThe old mill sold\r\n")[0] == 7
    for blank in ("", " ", "\n \n\t"):
        assert ends_of(model, blank) == []


@pytest.mark.parametrize("closers", ["”)]}", "”)]})", "»)»\"”", ")" * 3000, " ) ) )"])
def test_closers_are_taken_to_their_end(closers):
    text = f"({{[(“A b.{closers} Next one"
    c = S.Text([text]).candidates()
    assert c.end[0] - 2 + 1 == text.index(" Next")


def test_marks_join_over_any_number_of_blanks():
    for n in (1, 3, 4, 50):
        c = S.Text(["He went ." + " " * n + ". on"]).candidates()
        assert c.k == 1 and c.ellipsis[0] and c.last[0] - c.first[0] == n + 1


def test_openers_are_found_at_any_distance_and_by_sort():
    t = S.Text(["“" + "The board’s clerk said (so it is ‘told’) nothing. " * 150 + "The end.” He went.", "A b.”"])
    c = t.candidates()
    start, found = c.opened_at_start(c.quote_at, t.openers())
    assert c.quoted.sum() == 2 and found[c.quoted].tolist() == [True, False] and start[c.quoted].tolist() == [True, False]


def test_labels_stay_when_the_corpus_is_repeated():
    rng = random.Random(7)
    texts = [split_marks(page(rng))[0] for _ in range(150)]
    labels = []
    for corpus in (texts, texts * 10):
        t = S.Text(corpus)
        stats = S.Statistics.of(*S.Statistics.count(t, t.candidates()))
        labels.append(S.features(S.Text(texts).candidates(), stats)[1])
    assert (labels[0] == labels[1]).all() and {0, 1} <= set(labels[0].tolist())


def test_line_ends_of_thai_text_end_nothing():
    c = S.Text(["โรงสี\r\nโรงสี โรงสี \r\nโรงสี"]).candidates()
    assert c.end[c.thai].tolist() == [2 + 11, 2 + 17]


def test_thai_blanks_are_candidates():
    c = S.Text(["เปิด 5 ชิ้น ต่าง ๆ นานา โรงสี"]).candidates()
    assert (c.thai & ~c.guarded).sum() == 2 and (c.thai & c.guarded).sum() == 3


def test_greek_and_odd_marks():
    t = S.Text(["θερμοκήπια; Ο", "a; b", "परखा| हम", "x | y"])
    assert [chr(t.cp[i]) for i in np.flatnonzero(t.mark)] == [";", "|"]


def test_frame(spark):
    rng = random.Random(4)
    rows = [(i, split_marks(page(rng))[0], "x") for i in range(60)] + [(900, None, "x"), (901, "", "x"), (902, "  \n\n ", "x"), (903, "no mark at all", "x"), (904, "a. " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, end_pos string")
    got = S.split_sentences(df, "doc_id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["end_pos"])
    assert not {900, 901, 902} & set(by) and by[903] == [14] and set(range(60)) <= set(by)
    assert all(len(v) == len(set(v)) for v in by.values())
    assert S.split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_rare_tokens_only_count_in_the_totals(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(split_marks(page(rng))[0],) for _ in range(80)], "text string")
    whole, few = S.statistics(df, "text"), S.statistics(df, "text", tokens=20)
    assert len(few.token) == 21 and len(whole.token) > 21 and few.end_rate == whole.end_rate
    at, other = few.place(few.token[:-1]), whole.place(few.token[:-1])
    assert (few.stops[at] == whole.stops[other]).all() and (few.tokens[at] == whole.tokens[other]).all()


def by_whole_statistics(spark, df):
    """Ends with the statistics of all tokens in one table."""
    rows = df.collect()
    stats = S.statistics(df, "text", tokens=1 << 20)
    weights = S.train(df, "doc_id", "text", spark.sparkContext.broadcast(stats))
    owner, ends = S.sentence_ends([r["text"] for r in rows], stats, weights)
    return sorted((rows[i]["doc_id"], e) for i, e in zip(owner.tolist(), ends.tolist())), len(stats.token) - 1


def test_ends_do_not_depend_on_the_tokens_sent_to_the_tasks(spark):
    rng = random.Random(6)
    texts = [split_marks(page(rng))[0] for _ in range(150)] + ["โรงสี โรงสี 5 ชิ้น โรงสี", "A b. C d.” E f.\r\n\r\n", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, texts[0]])], "doc_id long, text string")
    want, _ = by_whole_statistics(spark, df)
    for tokens in (0, 1, 20, 1 << 18):
        got = S.split_sentences(df, "doc_id", "text", tokens=tokens)
        assert sorted(map(tuple, got.collect())) == want and got.schema.simpleString() == "struct<doc_id:bigint,end_pos:int>"


def test_tokens_beyond_the_most_frequent_keep_their_rates(spark):
    """More than TOKENS fillers, three times each, and abbreviations that occur twice: before a small letter and before a capital."""
    rng = random.Random(8)
    letters = "bcdfghjklmnpqrstvwxz"
    word = lambda k: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(k))
    short = [word(3) for _ in range(60)]
    texts = [split_marks(page(rng))[0] for _ in range(10)] + [f"The clerk sold {a}. {word(4)} at the mill" for a in short] + [
        f"The clerk sold {a}. {word(4).capitalize()} at the mill" for a in short]
    words = [a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in "yh"]
    assert len(words) > S.TOKENS
    fillers = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)] * 3
    df = spark.createDataFrame(list(enumerate([*texts, *fillers])), "doc_id long, text string")
    want, n = by_whole_statistics(spark, df)
    assert n > S.TOKENS
    assert sorted(map(tuple, S.split_sentences(df, "doc_id", "text").collect())) == want
