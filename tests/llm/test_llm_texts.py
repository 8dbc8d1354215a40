import os

import pytest

from vecquarry.llm import mixing, quality, tokens

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [None, "", " ", "  \n\t ", "Hello, world! It's 3.14 o'clock we'll see", "<|endoftext|> text", "日本語 русский العربية", "a b c\u0085d​e﻿f", "🙂👍🏽 emoji", "x" * 5000, "word " * 30000, "\r\n\r\nend  ", "'s 't 're", "\U0001e4d0\U00010d4a new letters Ᲊ", "tab\ttab", "12 ½ Ⅷ ²"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, words string, ids array<int>").repartition(3)


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_ids(docs, chunk):
    t = tokenizers.Tokenizer.from_file(os.path.join(tokens.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(docs, chunk=chunk).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_words_are_those_of_the_pattern():
    import random

    import regex

    rng = random.Random(1)
    letters = ["a", "s", "t", "re", "ve", "ll", "m", "d", "'", "'", " ", " ", "\n", "\u00a0", "1", "½", ".", "!", "é", "日", "x" * 70]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(4000)]
    words, codes, ends = tokens.distinct_words(texts)
    assert len(set(words)) == len(words)
    want = [regex.findall(tokens.PATTERN, t) for t in texts]
    starts = [0, *ends[:-1]]
    assert [[words[c] for c in codes[a:b]] for a, b in zip(starts, ends)] == want


def test_round_trip_repeats_and_empty(spark, docs):
    assert {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    twice = tokens.encode(docs.unionAll(docs)).filter("doc_id = 4").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert tokens.encode(docs.limit(0)).count() == 0 and tokens.token_counts(docs).filter("doc_id < 2").agg({"tokens": "sum"}).first()[0] == 0
    assert tokens.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first()["text"] is None
    with pytest.raises(Exception, match="vocabulary"):
        tokens.decode(spark.createDataFrame([(1, [60000])], "doc_id bigint, ids array<int>")).collect()


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 4}", (i * 37) % 200) for i in range(3000)] + [(9000 + i, "small", 20 + i) for i in range(10)] + [(9999, None, 5), (10000, "other", 9)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").repartition(4).cache()


def test_shares_are_met(spark, counted):
    rows, docs = counted
    targets = spark.createDataFrame([("hot", 0.4, 2), ("s1", 0.3, 1), ("small", 0.1, 3), ("s2", 0.2, 5), ("none", 0.2, 1)], "source string, target_weight double, max_repeats int")
    m = mixing.mix(docs, targets)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert shares["none"]["share"] == 0 and shares["none"]["docs"] == 0
    for s, w in (("hot", 0.4), ("s1", 0.3), ("small", 0.1), ("s2", 0.2)):
        assert shares[s]["share"] == pytest.approx(w, abs=0.003) and shares[s]["most_copies"] <= shares[s]["max_repeats"]
    assert shares["small"]["most_copies"] == 3 and shares["small"]["mixed_tokens"] == 3 * sum(t for _, s, t in rows if s == "small")
    got = {r["doc_id"]: r for r in m.documents.collect()}
    assert set(got) == {i for i, s, _ in rows if s in ("hot", "s1", "s2", "small")}
    assert all(r["copies"] == 0 for r in got.values() if r["tokens"] == 0) and all(abs(r["copies"] - r["rate"]) <= 2 for r in got.values())


def test_budget_makes_small_sources_full(spark, counted):
    _, docs = counted
    targets = spark.createDataFrame([("hot", 0.5, 2), ("small", 0.5, 3)], "source string, target_weight double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mix(docs, targets, budget=50_000).shares.collect()}
    assert shares["small"]["most_copies"] == 3 and shares["small"]["mixed_tokens"] == 3 * 245
    assert shares["hot"]["mixed_tokens"] == pytest.approx(50_000 - 735, abs=100)


def test_mixing_edges(spark, counted):
    _, docs = counted
    targets = spark.createDataFrame([("hot", 1.0, 1)], "source string, target_weight double, max_repeats int")
    assert mixing.mix(docs.limit(0), targets).documents.count() == 0
    whole = mixing.mix(docs, targets).documents
    assert whole.filter("tokens > 0 AND copies <> 1").count() == 0
    for bad in ([("a", None, 1)], [("a", 0.5, 0)], [("a", 0.5, 1), ("a", 0.5, 1)], [(None, 0.5, 1)]):
        with pytest.raises(ValueError):
            mixing.mix(docs, spark.createDataFrame(bad, "source string, target_weight double, max_repeats int"))


PROSE = [
    "The committee met on Tuesday and decided that the bridge should be closed for two weeks while it is being repaired.",
    "Wir sind gestern mit dem Zug nach Hause gefahren, weil das Auto nicht mehr funktioniert hat und es zu spät war.",
    "IT IS NOT CLEAR WHETHER THE NEW RULES WILL BE OF ANY HELP TO THOSE WHO HAVE ALREADY LEFT THE CITY.",
    "<p>Nous n'avons pas encore reçu la réponse, mais elle devrait arriver dans les jours qui viennent. 🙂</p>",
]
OTHER = [
    "\n".join(f"| row{i} | {i * 7.25} | {i * 113} | 0.{i}91 |" for i in range(9)),
    "apple chair river stone cloud paper horse table glass metal flower mountain butter candle ocean planet",
    "\n".join(f"key_{c}_name: {i * 3}" for i, c in enumerate("abcdefgh")),
    "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgdGV4dCB3aXRoIG1hbnkgY2hhcnM9PQ0KZm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA",
    "for (int i = 0; i < n; ++i) { total[i] += price[i] * 42; }\nif (x != null) { return x.y(z) + 1; }",
]


def test_quality(spark):
    rows = [(i, t) for i, t in enumerate([*PROSE, *OTHER, None, "", " \n ", PROSE[0] + "\n" + OTHER[0], "\n".join([PROSE[0]] * 3) + "\nkey: 4"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("words", docs_clash()).repartition(3)
    common = spark.read.parquet("/root/testdata/sf0.001/common_words.parquet")
    got = {r["doc_id"]: r for r in quality.quality(docs.unionAll(docs.filter("doc_id = 1")), common).collect()}
    n = len(PROSE)
    assert [got[i]["form"] for i in range(n)] == ["prose"] * n
    assert all(got[n + i]["form"] not in ("prose", None) for i in range(len(OTHER)))
    for i in range(n + len(OTHER), n + len(OTHER) + 3):
        assert got[i]["form"] is None and got[i]["words"] == 0
    assert got[len(rows) - 2]["form"] != "prose" and got[len(rows) - 1]["form"] == "prose" and len(got) == len(rows)
    assert got[0]["words"] == 21 and got[0]["ending_share"] == 1 and got[0]["common_share"] > 0.3
    assert quality.quality(docs.limit(0), common).count() == 0


def docs_clash():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_statistics_of_lines():
    common = quality.word_hashes(["the", "été", "我"])
    text = "The ÉTÉ of  x1,y\n\n<b>camelCase</b> a.b(c) ?!\r\n我去 ok”\u200b. "
    owner, counts, stats = quality.texts_statistics([None, "", text, " \n", "a"], common)
    assert owner.tolist() == [2, 2, 2, 4]
    by = [dict(zip(quality.COUNTS, c)) for c in counts.tolist()]
    # chars, words, word_chars, common_words, symbol_chars, ends
    assert by[0] == {"chars": 12, "words": 5, "word_chars": 10, "common_words": 2, "symbol_chars": 0, "ends": 0}
    assert by[1] == {"chars": 17, "words": 4, "word_chars": 12, "common_words": 0, "symbol_chars": 0, "ends": 1}
    assert by[2] == {"chars": 6, "words": 3, "word_chars": 4, "common_words": 1, "symbol_chars": 0, "ends": 1}
    assert round(stats[1][quality.STATISTICS.index("turns")] ** 2 * 17) == 3 and stats[0][0] == 0.4


def test_long_texts_are_worked_on_in_pieces(monkeypatch):
    text = "\n".join(f"Line {i} has a few words, and it ends here." for i in range(400))
    common = quality.word_hashes(["a", "it"])
    whole = quality.texts_statistics([text, "b c", text], common)
    monkeypatch.setattr(quality, "PIECE", 100)
    for a, b in zip(whole, quality.texts_statistics([text, "b c", text], common)):
        assert a.tolist() == b.tolist()


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "<br/> https://a.b/c"), (None, "Some text."), (2, "\U0001f680")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.quality(docs, spark.createDataFrame([], "word string")).collect()}
    assert {k: (r["form"], r["words"], r["junk"]) for k, r in got.items()} == {1: ("junk", 0, 1.0), 2: ("junk", 0, 1.0)}
