"""What large tables and odd texts brought to light: work that grows too fast, texts that broke a query, rows that SQL gives otherwise."""

import math
import re
import time
from collections import Counter

import duckdb
import numpy as np
from conftest import DATA

from condensa import catalog
from condensa.operators import dedup, ranking, scoring


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_marginal_relevance_of_a_long_text_takes_no_square_of_overlaps(spark):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(1)
    texts = [[set(rng.choice(words, rng.integers(0, 12)).tolist()) for _ in range(n)] for n in (3000, 5, 0, 90, 3, 90)]
    rows = [(i, [(p, round(len(t) / (len(t) + 10), 6), sorted(t)) for p, t in enumerate(s)]) for i, s in enumerate(texts)]
    start = time.time()
    found = ranking.mmr_sections(spark.createDataFrame(rows, "doc_id long, s array<struct<pos:int,score:double,set:array<string>>>")).collect()
    assert time.time() - start < 30  # minutes, when every step formed the overlaps of sets anew
    got = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["place"])):
        got.setdefault(r["doc_id"], []).append(r["pos"])
    assert set(got) == {0, 1, 3, 4, 5} and sorted(got[0]) == list(range(3000))
    for i, s in rows[1:]:
        left = sorted(s, key=lambda x: (-x[1], x[0]))
        most, want = {x[0]: 0.0 for x in s}, []
        while left:
            best = max(left, key=lambda x: 0.7 * x[1] - (1 - 0.7) * (most[x[0]] if len(s) > 3 else 0.0))
            left.remove(best)
            want.append(best[0])
            for x in left:
                a, b = set(x[2]), set(best[2])
                most[x[0]] = max(most[x[0]], len(a & b) / len(a | b) if a and b else 0.0)
        assert got.get(i, []) == want, i
    assert shuffles(catalog.queries()["mmr_sections"](spark, DATA)) == 0


def test_marginal_relevance_is_the_same_by_both_ways(monkeypatch):
    rng = np.random.default_rng(2)
    sections = rng.integers(1, 40, 30)
    size = rng.integers(0, 9, sections.sum())
    token = np.concatenate([rng.choice(60, n, replace=False) for n in size]).astype(np.int64)
    score = np.concatenate([np.sort(rng.random(n).round(2))[::-1] for n in sections])
    together = ranking._selected(score, sections, size, token, 0.7)
    monkeypatch.setattr(ranking, "TOGETHER", 0)
    assert (ranking._selected(score, sections, size, token, 0.7) == together).all()


RUN = "So " + "the a an The\t" * 30000 + "end. " + "a " * 20 + "b"


def test_long_runs_of_articles_take_no_stack(spark):
    # each article took stack: the whole of Spark ended with these
    got = {name: catalog_rows(spark, name, ["The cat", RUN, None, ""]) for name in ("article_removal", "lexical_similarity_guard", "guarded_candidates", "rewrite_documents")}
    assert [r["text"] for r in got["article_removal"]] == ["cat", "So end. b", None, ""]
    assert [r["kept"] for r in got["lexical_similarity_guard"]] == [False, False, None, False]
    assert [(r["doc_id"], r["name"]) for r in got["guarded_candidates"]] == [(0, "none"), (1, "none")]
    assert [r["tokens_after"] for r in got["rewrite_documents"]][:2] == [2, 120023]


def catalog_rows(spark, name, texts):
    """The rows of a query of documents alone, over these texts."""
    from unittest import mock

    with mock.patch("condensa.sources.io.table", lambda *_: docs(spark, texts)):
        return catalog.queries()[name](spark, "").orderBy("doc_id").collect()


def test_canonical_gate_reads_words_as_its_sql(spark, tmp_path):
    texts = ["camino señ no", "aéno b", "ño", "año nö", "übernot.", "énot", "it iſn't so", "ſtupid", "aın İn", "IN", None, "", "a no_b", "never?", "Worthleſs", "éno", "nó x", "not٠ y"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["canonical_gate"](spark, str(tmp_path)).orderBy("doc_id").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(catalog.oracle_sql()["canonical_gate"] + " ORDER BY doc_id").fetchall()


def ranked_rows(df):
    return sorted(map(tuple, df.select("item_id", "doc_id", "score", "rank").collect()))


def test_ranking_by_tasks_is_that_by_joins(spark, monkeypatch):
    documents, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    documents = documents.unionByName(documents.selectExpr(*[f"{c} + 1000 doc_id" if c == "doc_id" else c for c in documents.columns])).unionByName(spark.createDataFrame([(5000, None), (5001, "?!"), (5002, "")], "doc_id long, text string"), True)
    bm25, tfidf = ranking.bm25(documents, benchmark), ranking.tfidf(documents, benchmark)
    # the plan has neither the documents' tokens nor pairs of documents and items as rows
    assert all("Generate" not in x._jdf.queryExecution().executedPlan().toString() for x in (bm25,))
    got = ranked_rows(bm25), ranked_rows(tfidf)
    monkeypatch.setattr(scoring, "MOST_KNOWN", 40)
    assert ranked_rows(ranking.tfidf(documents, benchmark)) == got[1]  # most tokens' df is joined to candidates
    monkeypatch.setattr(scoring, "AT_ONCE", 64)
    assert (ranked_rows(ranking.bm25(documents, benchmark)), ranked_rows(ranking.tfidf(documents, benchmark, 10))) == got
    monkeypatch.setattr(scoring, "MOST_ASKED", 0)
    assert (ranked_rows(ranking.bm25(documents, benchmark)), ranked_rows(ranking.tfidf(documents, benchmark))) == got


def test_passages_by_tasks_are_those_by_joins(spark, monkeypatch):
    documents = docs(spark, ["a b c d", "x a B C", "b c", "a b", "c", None, "d'a b; c", "a b c a b c"])
    passages = spark.createDataFrame([("p", ["a", "b", "c"]), ("q", ["b", "c", "d"]), ("r", ["a", "b", "c"]), ("s", ["b", "c", "z"])], "item_id string, t array<string>")
    rows = lambda: sorted({tuple(r) for r in ranking.holders(documents, passages, 3).collect()})
    got = rows()
    assert got == [("p", 0), ("p", 1), ("p", 7), ("q", 0), ("r", 0), ("r", 1), ("r", 7)]
    monkeypatch.setattr(scoring, "MOST_ASKED", 0)
    assert rows() == got


def test_bigram_entropy_counts_pairs_where_texts_lie(spark, tmp_path):
    texts = ["aa", "ab", "a", "", None, "abab\nba", "é😀é😀x", "a\u0000b\U0010ffff", "x" * 3000, "ab" * 700000]
    docs(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.queries()["char_bigram_entropy"](spark, str(tmp_path))
    got = {r["doc_id"]: r["entropy"] for r in df.collect()}
    want = {}
    for i, t in enumerate(texts):
        if t and len(t) > 1:
            n = Counter(zip(t, t[1:]))
            want[i] = -sum(c / (len(t) - 1) * math.log2(c / (len(t) - 1)) for c in n.values())
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert shuffles(df) == 0


def test_lookback_reads_each_sentence_once(spark):
    line = "the quick brown fox number {} went over the hill to see what was there today."
    # many near sentences of one text: the first stays, and its followers within eight places go
    texts = [" ".join(line.format(i % 7) for i in range(20000)), "One fox ran. one fox ran. ONE FOX RAN!", None, "", "é b c. é b c.", "?! ?!"]
    start = time.time()
    found = dedup.kept_sentences(docs(spark, texts)).collect()
    assert time.time() - start < 30
    got = {}
    for r in sorted(found):
        got.setdefault(r["doc_id"], []).append(r["kept"])
    assert got[1] == [True, False, False] and got[4] == [True, False] and got[5] == [True, True] and set(got) == {0, 1, 4, 5}
    assert len(got[0]) == 20000 and got[0][:9] == [True] + [False] * 8 and got[0].count(True) == 2223
    assert shuffles(catalog.queries()["near_dup_lookback"](spark, DATA)) == 0


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abé "), rng.integers(0, 80))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert dedup._edits(a, b) == row[-1]


def test_near_pairs_shuffle_no_whole_sets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "one", "?!"]
    for _ in range(40):
        base = rng.choice(words, rng.integers(2, 60)).tolist()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts.append(texts[-1] + " ! ")
    want, sets = set(), {}
    for i, t in enumerate(texts):
        t = re.findall("[a-z0-9']+", (t or "").lower())
        if len(t) > 1:
            sets.setdefault(frozenset(zip(t, t[1:])), i)
    rows = [(i, s) for s, i in sets.items()]
    for i, x in rows:
        want |= {(i, j, len(x & y) / len(x | y)) for j, y in rows if i < j and len(x & y) / len(x | y) >= 0.8}
    pairs = lambda: {tuple(r) for r in dedup.bigram_pairs(docs(spark, texts)).collect()}
    assert pairs() == want and len(want) > 30
    monkeypatch.setattr(dedup, "GROUP", 1)
    monkeypatch.setattr(dedup, "IDS", 0)
    assert pairs() == want
    # rows of word pairs that travel: those of the first that stand in several sets, of all of a set before
    many = docs(spark, [" ".join(f"x{i}y{j}" for j in range(200)) for i in range(50)])
    assert dedup.bigram_pairs(many).count() == 0
