import random

from docsift.functions import text as T
from docsift.operators import matching, phrases

JD = "jd_id int, text string"
DOC = "doc_id int, text string"


def known(spark):
    rows = [("gcp", "Google Clouds"), ("ab", "a b"), ("b c d", "bcd"), ("c d", "cd"), ("a b", "first"), ("x", "a b"), ("d e", "de"), ("e f", "ef")]
    return phrases.dictionary(spark.createDataFrame(rows, "alias string, canonical string"))


def test_dictionary_has_phrases_of_both_columns_and_aliases_come_first(spark):
    rows = {r.phrase: (r.n, r.canonical) for r in known(spark).collect()}
    assert rows == {"google cloud": (2, "google cloud"), "a b": (2, "first"), "b c d": (3, "bcd"), "c d": (2, "cd"), "d e": (2, "de"), "e f": (2, "ef")}


def settle(words, table, longest):
    """Leftmost, then longest, by reading on."""
    at, out = 0, []
    while at < len(words):
        for n in range(longest, 1, -1):
            name = table.get(" ".join(words[at : at + n]))
            if name and at + n <= len(words):
                out.append((at, n, name))
                at += n - 1
                break
        at += 1
    return out


def test_found_and_settled_equal_reading_on(spark):
    rng = random.Random(3)
    table = {r.phrase: r.canonical for r in known(spark).collect()}
    texts = [(i, [rng.choice("abcdefx") for _ in range(rng.randrange(40))]) for i in range(120)] + [(900, []), (901, ["a", "b"] * 3000), (902, ["b", "c", "d", "e", "f"] * 500)]
    rows = spark.createDataFrame([(i, w, "clash") for i, w in texts], "doc_id int, terms array<string>, canonical string")
    sizes = phrases.lengths(known(spark))
    hits = phrases.found(rows, known(spark), sizes, ["doc_id"])
    want = sorted((i, at, n, table[" ".join(w[at : at + n])]) for i, w in texts for n in (2, 3) for at in range(len(w) - n + 1) if " ".join(w[at : at + n]) in table)
    assert sorted((r.doc_id, r.place, r.n, r.canonical) for r in hits.collect()) == want
    stand = phrases.settled(hits, ["doc_id"])
    assert sorted((r.doc_id, r.place, r.n, r.canonical) for r in stand.collect()) == sorted((i, *x) for i, w in texts for x in settle(w, table, 3))


def test_plurals_meet_and_the_run_stays_as_it_stands(spark):
    rows = spark.createDataFrame([(1, "Google  clouds; gcp")], DOC).select("doc_id", T.terms("text").alias("terms"))
    got = phrases.found(rows, known(spark), [2], ["doc_id"]).collect()
    assert [(r.place, r.run, r.canonical) for r in got] == [(0, "google clouds", "google cloud")]


def test_a_text_with_the_long_form_only_covers_the_short_one_and_back(spark):
    jds = spark.createDataFrame([(1, "Requirements\n- ML\n- GCP\nNice to have\n- AI"), (2, "Requirements\n- machine learning\n- Google Cloud Platform"), (3, None)], JD)
    docs = spark.createDataFrame([(10, "Machine\nlearning on Google Cloud"), (11, "ML, gcp and artificial intelligence"), (12, "learning about a machine; the cloud of google"), (13, None)], DOC)
    got = {(r.jd_id, r.doc_id): (r.coverage_required, r.n_matched, r.n_terms) for r in matching.coverage(docs, jds).collect()}
    assert got == {(1, 10): (1.0, 2, 3), (1, 11): (1.0, 3, 3), (2, 10): (1.0, 2, 2), (2, 11): (1.0, 2, 2)}
    terms = {(r.jd_id, r.term, r.canonical) for r in matching.jd_terms(jds).collect()}
    assert terms == {(1, "ml", "machine learning"), (1, "gcp", "google cloud"), (1, "ai", "artificial intelligence"), (2, "machine learning", "machine learning"), (2, "google cloud platform", "google cloud")}


def test_words_of_a_phrase_ask_for_nothing_else_but_other_places_do(spark):
    jds = spark.createDataFrame([(1, "machine learning\nlearning")], JD)
    assert {r.canonical for r in matching.jd_terms(jds).collect()} == {"machine learning", "learning"}


def test_own_spellings_as_dict_and_as_rows(spark):
    jds = spark.createDataFrame([(1, "Event Streams, IaC")], JD)
    docs = spark.createDataFrame([(5, "kafka and infrastructure as codes")], DOC)
    own = {"event stream": "kafka", "iac": "infrastructure as code"}
    rows = spark.createDataFrame(list(own.items()), "alias string, canonical string")
    for more in (own, rows):
        assert [(r.n_matched, r.n_terms) for r in matching.coverage(docs, jds, more).collect()] == [(2, 2)]
        assert matching.missing(spark.createDataFrame([(1, 5)], "jd_id int, doc_id int"), docs, jds, more).count() == 0


def test_descriptions_are_cut_by_argument_only_and_say_so(spark):
    jds = spark.createDataFrame([(1, "abc\n" * 20000), (2, "abc"), (3, None)], JD)
    cut = matching.jd_lines(jds).groupBy("jd_id", "clipped").count().collect()
    assert {(r.jd_id, r.clipped, r["count"]) for r in cut} == {(1, True, 15000), (2, False, 1)}
    assert {(r.jd_id, r.clipped, r["count"]) for r in matching.jd_lines(jds, None).groupBy("jd_id", "clipped").count().collect()} == {(1, False, 20000), (2, False, 1)}
