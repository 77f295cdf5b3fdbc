"""Operators 11 to 13 against plain Python on odd rows, hot groups and random cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condensa.llm import common, phraseindex, prefixtrie, variants

DOCS = "doc_id long, text string, n long, word string, id long, digest long, n_words long"
ITEMS = "item_id long, text string, w string"


# --- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=5, max_size=8), max_size=80))
def test_two_automata_find_each_near_pair_once(words):
    words = sorted(words)
    lookups = [(w, c) for w in words for c in (-1, 0, 1)]
    got = []
    for backward in (False, True):
        left, right = variants.looked_up(words, [w for w, _ in lookups], [len(w) // 2 for w, _ in lookups], [c for _, c in lookups], backward)
        got += [(lookups[i][0], words[j]) for i, j in zip(left, right)]
    assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_automata_number_words_in_order_and_share_endings():
    words = sorted(f"{a}{b}ing" for a in ("walk", "talk", "look") for b in ("", "er", "ers"))
    automaton = variants.Automaton(words)
    assert [automaton.walk(w, automaton.start, 0)[1] for w in words] == list(range(len(words)))
    assert len(automaton.edges) < len({w[:i] for w in words for i in range(len(w) + 1)}) - 10


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "[" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            n[run if doc_id is None or h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    around = {w: sorted((v for v in n if near(v, w)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: a[0] if a and n[a[0]] >= 2 * n[w] else None for w, a in around.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(around[w]), n[form[w]] if form[w] else -1) for w in n)


def test_variants_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [(None, "Lonely LONELY lonely"), (1, None), (2, ""), (3, "a bb"), (4, "Wörter wörter WÖRTER"), (4, "Wörter wörter WÖRTER")]
    for i in range(400):
        words = rng.choices(base, [1 / (k + 1) for k in range(60)], k=30)
        rows.append((i, " ".join(w if rng.random() < 0.9 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "xé"]) + w[k + 1 :] for w in words)))
    rows += [(1000, "abcdefgh " * 16 + "abcdefghi " * 8 + "abcdefghij " * 4)]  # a form of a form
    docs = spark.createDataFrame([(d, t, 0, "x", 0, 0, 0) for d, t in rows], DOCS)
    rows_of = lambda: sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in variants.variants(docs).collect())
    want = plain_variants(rows)
    assert any(x[1] and x[2] != x[1] for x in want) and len(want) > 100
    assert rows_of() == want
    # halves that more words share than a part holds are dealt out by blocks
    monkeypatch.setattr(variants, "PART", 6)
    assert rows_of() == want
    words = variants.vocabulary(docs)
    assert {(r.word, r.near) for r in variants.near_words(words).collect()} == {(w[0], v[0]) for w in want for v in want if near(w[0], v[0])}
    assert variants.variants(docs.limit(0)).count() == 0


# --- prefix trie


def plain_tree(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), role, text))
    turns = {c: [x[1:] for x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c, t in turns.items():
        h, first = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(turns.get(first, [])[:h] + t[h:])
    nodes = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = ",".join(str(c) for c in sorted(c for c in members if made[c] == key))
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children[key]), sum(not children[k] for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tree_of(spark, rows):
    table = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, d long, n long, label string")
    return sorted(map(tuple, prefixtrie.prefix_tree(*prefixtrie.rebuilt(table)).collect()), key=str)


@pytest.mark.parametrize("local", [20_000, 100, 0])
def test_tree_by_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(prefixtrie, "RANGE", 2)
    monkeypatch.setattr(prefixtrie, "LOCAL", local)
    rng = random.Random(7)
    rows = [(None, 0, "user", "nobody"), (3, None, "user", "before all"), (3, 0, None, None), (3, 1, "a", "same"), (3, 1, "a", "same"), (3, 1, "b", "tie"), (-7, 0, "user", "é"), (-5, 0, "user", "minus five"), (1007, 0, "user", "one turn only")]
    for c in range(10, 60):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["x", "yé", "a b c"])) for t in range(rng.randint(1, 14))]
    # copies of one long conversation, and one that leaves it late
    rows += [(c, t, "user", f"t{t}") for c in range(100, 140) for t in range(40)] + [(200, t, "user", f"t{t}" if t < 38 else "other") for t in range(40)]
    assert tree_of(spark, rows) == plain_tree(rows)


def test_tree_of_one_turnless_and_no_conversation(spark):
    # the number's hash takes more turns than the family's first, which isn't there, can give
    gone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(gone, 0, "user", "a"), (gone, 1, "user", "b")]
    assert tree_of(spark, rows) == plain_tree(rows) == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]
    assert tree_of(spark, []) == []
    assert tree_of(spark, [(None, 0, "user", "a")]) == []


# --- phrases


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, size=10):
    phrases = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            phrases[tuple(w[s : s + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for k in {len(p) for p in phrases}:
            for s in range(len(w) - k + 1):
                if (p := tuple(w[s : s + k])) in phrases:
                    hit |= set(range(s, s + k))
                    found |= {str(i) for i in phrases[p] if i is not None}
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def phrase_case(seed=11):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["é", "日本", "it", "1"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(40)]
    items += [(100, "is " * 15), (101, None), (102, ""), (103, "!!"), (104, items[0][1]), (None, items[3][1]), (105, "never seen anywhere"), (0, "w1 w2 w3")]
    docs = [(None, items[5][1]), (1, None), (2, ""), (3, items[6][1].upper()), (3, "another text " + items[7][1]), (4, "is " * 200), (4, "is " * 200), (5, "Is\nis, " * 8 + items[9][1])]
    for d in range(10, 80):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(3)]
        docs.append((d, f" {rng.choice(['-', ' '])}".join(x for p in parts for x in (p, " ".join(plain_words(rng.choice(items)[1])[: rng.randint(5, 30)])))))
    docs.append((999, " ".join(rng.choices(words, k=3000)) + " " + items[6][1]))
    return docs, items


@pytest.mark.parametrize("few", [50_000, 0])
def test_phrases_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(phraseindex, "SMALL", few)
    docs, items = phrase_case()
    a = spark.createDataFrame([(d, t, 0, "x", 0, 0, 0) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in phraseindex.decontaminate(a, b).collect())
    assert got == plain_hits(docs, items)


def test_phrases_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0, "x", 0, 0, 0)], DOCS), spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert phraseindex.decontaminate(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in phraseindex.decontaminate(docs, items.limit(0)).collect()] == [0]


def test_proximity_by_brute_force(spark):
    docs, items = phrase_case(12)
    docs, items = [x for x in docs if x[0] != 4], [x for x in items if x[0] is None or len(plain_words(x[1])) <= 5]
    n = Counter(w for _, t in docs for w in plain_words(t))
    want = set()
    for item, text in items:
        terms = set(plain_words(text))
        if item is None or not terms or any(not n[t] for t in terms):
            continue
        rare = min(terms, key=lambda t: (n[t], t))
        for doc, body in docs:
            w = plain_words(body)
            at = defaultdict(list)
            for i, x in enumerate(w):
                at[x].append(i)
            want |= {(doc, str(item), p) for p in at[rare] if doc is not None and all(any(abs(p - q) <= 7 for q in at[t]) for t in terms)}
    a = spark.createDataFrame([(d, t, 0, "x", 0, 0, 0) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    assert len(want) > 50 and set(map(tuple, phraseindex.proximity_matches(a, b, 7).collect())) == want


def test_vectors_too_large_for_scores_and_ids_with_several_vectors(spark):
    from condensa.llm import maxscore

    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1e300, 1.0]), (4, [65536.0, 0.0]), (5, [-65535.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in maxscore.top_k(vectors, vectors.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(100, 1, 2, 3 * 1024**2), (100, 2, 1, 0), (100, 3, 5, 0)]


@pytest.mark.parametrize("few", [0, 50_000])
def test_only_texts_with_candidates_are_cut_into_stretches(spark, monkeypatch, few):
    monkeypatch.setattr(phraseindex, "SMALL", few)
    cut = spark.sparkContext.accumulator(0)
    words, marked = phraseindex.words, F.udf(lambda t: cut.add(1) or t)
    monkeypatch.setattr(phraseindex, "words", lambda text: words(marked(text)))
    docs = spark.createDataFrame([(i, f"Words of text {i}") for i in range(100)], "doc_id long, text string")
    found = phraseindex.named(docs.where("doc_id in (3, 5)")).select("id", "digest")
    rows = phraseindex.stretches(docs, common.checkpoint(found), 10).collect()
    assert sorted((r.id, r.b, r.base, r.d) for r in rows) == [(i, 0, 0, ["words", "of", "text", str(i)]) for i in (3, 5)]
    assert cut.value <= 4


def test_words_are_counted_without_lower_case(spark):
    texts = [None, "", " \n", "One two2THREE", "@A[Z`z{0/9:", "É Àß naïve—ok", "日本 ABC　x y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(phraseindex.words(F.col("t"))).alias("a"), phraseindex.n_words(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[3].b == 2 and rows[4].b == 5


def test_words_of_all_ascii_and_other_code_points(spark):
    each = [chr(c) for c in range(0x250)] + list("\u2003\u212a\ufeff\ud7ff\uffff日😀\U0010ffff")
    rng = random.Random(5)
    texts = each + ["".join(each), "x".join(each)] + ["".join(rng.choices(each + [*"aZ09 .\0"] * 40, k=60)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", phraseindex.words(F.col("t")).alias("w"), phraseindex.n_words(F.col("t")).alias("n")).collect()
    assert len(got) == len(texts) and all(r.w == plain_words(r.t) and r.n == len(r.w) for r in got)


def test_words_take_little_more_than_reading_each_character(spark):
    docs = common.checkpoint(spark.range(4000).select(F.repeat(F.lit("Some words of a text, its 2 sentences; naïve ones. "), 60).alias("text")).repartition(4))

    def seconds(column):
        def once():
            began = time.perf_counter()
            docs.agg(F.sum(column)).collect()
            return time.perf_counter() - began

        return min(once() for _ in range(4))

    text = F.col("text")
    base = seconds(F.length(F.translate(text, "ABC", "abc")))
    assert seconds(F.size(phraseindex.words(text))) < 2 * base and seconds(phraseindex.n_words(text)) < 2 * base
