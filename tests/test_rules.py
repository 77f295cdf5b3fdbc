"""Queries that SQL can't express, and operators' edges, against plain versions and golden pairs."""

import math
import random
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from condensa import catalog
from condensa.functions import discourse, profiles
from condensa.functions import text as T
from condensa.operators import aliases, chats, dedup, notation, phrases, ranking, relational, structure
from condensa.sources import io
from condensa.streaming import sinks


def one(spark, f, *texts):
    names = "abc"[: len(texts)]
    return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


def split(text):
    return [s for s in (p.strip(" \t\r\f") for p in re.split(r"\n+|(?<=[.!?])[ \t\n\r\f]+", text or "")) if s]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_kept(sentences, cue):
    """One sentence after another, each against the kept ones of the eight before."""
    words = [set(re.findall("[a-z0-9_]+", s.lower())) for s in sentences]
    marks = [len(re.findall("[.!?]", s)) or 1 for s in sentences]
    kept = []
    for i, s in enumerate(sentences):
        drop = False
        for j in range(max(0, i - 8), i):
            if drop or not kept[j] or not words[i] or not words[j] or cue(s):
                continue
            overlap, ratio = len(words[i] & words[j]) / len(words[i] | words[j]), min(len(s) / len(sentences[j]), 1)
            if min(marks[i] / marks[j], marks[j] / marks[i]) < 0.7:
                continue
            longer = max(len(s), len(sentences[j]))
            drop = overlap * 0.7 + ratio * 0.3 >= 0.9
            if not drop and overlap >= 0.75 and ratio >= 0.75 and longer <= 240:
                d = distance(" ".join(s.lower().split()), " ".join(sentences[j].lower().split()))
                drop = d <= max(1, int((1.0 - 0.9) * longer)) and 1 - d / longer >= 0.9
        kept.append(not drop)
    return kept


def test_near_sentences_by_a_plain_loop(spark, texts):
    near = {-1: "The red fox ran over the hill today. The red fox ran over the hill today! You must go. You must go. A red fox ran over the hill today. The red foxes ran over the hill today.", -2: "", -3: None, -4: "?? !!"}
    some = near | {i: t for i, t in texts.items() if len(t) < 3000}
    got = {}
    for r in dedup.kept_sentences(spark.createDataFrame(list(some.items()), "doc_id long, text string")).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["kept"])
    cue = re.compile(T.CUE).search
    for i, t in some.items():
        assert got.get(i, []) == plain_kept(split(t), cue), i
    assert got[-1] == [True, False, True, True, False, False]


def test_budget_by_a_plain_loop(spark):
    rows = catalog.queries()["sentence_scores"](spark, DATA).collect()
    ratios = {r["doc_id"]: r for r in catalog.queries()["budget_ratios"](spark, DATA).collect()}
    by, want = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, s in by.items():
        total = sum(r["n_tokens"] for r in s)
        goal = max(1, math.floor(total * ratios[i]["ratio"]))
        kept, used = [], 0
        for r in sorted(s, key=lambda r: (not r["protected"], -r["score"], r["pos"])):
            if r["protected"] or (len(kept) < 120 and used < goal and (not kept or used + r["n_tokens"] <= goal)):
                kept.append(r["pos"])
                used += r["n_tokens"]
        want[i] = sorted(r["pos"] for r in s) if len(s) < 2 or goal >= total or (total - used) / total < 0.08 else sorted(kept)
    got = {}
    for r in catalog.queries()["budgeted_sentences"](spark, DATA).collect():
        got.setdefault(r["doc_id"], []).append(r["pos"])
    assert {i: sorted(p) for i, p in got.items()} == want


def test_marginal_relevance_by_a_plain_loop(spark, texts):
    got = {}
    for r in catalog.queries()["mmr_sections"](spark, DATA).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append(r["pos"])
    for i, t in texts.items():
        sets = [set(re.findall("[a-z0-9']+", s.lower())) for s in split(t)]
        if not 0 < len(sets) < 60:
            continue
        score = [math.floor(1e6 * len(s) / (len(s) + 10.0) + 0.5) / 1e6 for s in sets]
        like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0.0
        rest, out = sorted(range(len(sets)), key=lambda k: (-score[k], k)), []
        while rest:
            value = [0.7 * score[k] - 0.3 * (max((like(k, o) for o in out), default=0.0) if len(sets) >= 4 else 0.0) for k in rest]
            out.append(rest.pop(value.index(max(value))))
        assert len(got[i]) == len(out)
        # sums of doubles may tie otherwise in the last bit
        assert sum(a == b for a, b in zip(got[i], out)) >= 0.9 * len(out) and sorted(got[i]) == sorted(out)


def test_chunks_by_a_plain_loop(spark, texts):
    got = {}
    for r in catalog.queries()["greedy_chunks"](spark, DATA).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_tokens"]))
    for i, t in texts.items():
        want, now, used = [], [], 0
        for s in split(t):
            n = max(1, len(re.findall("[A-Za-z0-9_']+", s)))
            if now and used + n > 200:
                want.append((" ".join(now), used))
                now, used = [], 0
            now.append(s)
            used += n
        assert got.get(i, []) == want + ([(" ".join(now), used)] if now else [])


def test_short_decimals(spark):
    given = {"3.14159": "3.14", "2.000": "2", "-1.50000 x": "-1.5 x", "0.0012": "0.0012", "1234.5678": "1235", "1.234.567": "1.234.57", "12.34": "12.34", "no 1.0004 yes": "no 1 yes", "0.125": "0.12", "": ""}
    for a, b in given.items():
        assert one(spark, T.short_decimals, a) == b, a
    for r in catalog.queries()["numeric_precision"](spark, DATA).limit(200).collect():
        assert not re.search(r"\.\d{3}", re.sub(r"\b0\.00\d*", "", r["text"]))
    assert one(spark, T.plain_numbers, "001,234 and 1 234_567.50 and 12,34") == "1234 and 1234567.50 and 12,34"


def test_phrases(spark):
    rules = {"Machine Learning": "ML", "natural language processing": "NLP", "utilize": "use", "in order to": "to", " ": "x"}
    assert one(spark, lambda t: phrases.canonical(t, rules), "Utilize UTILIZE utilize uTilize machine learning, utilizes") == "Use USE use use ML, utilizes"
    assert one(spark, lambda t: phrases.canonical(t, {}), "as is") == "as is"
    assert one(spark, lambda t: phrases.canonical(t, {"in order": "x", "in order to": "to", "a+b (c)": "d"}), "In order to do a+b (c) in order") == "To do a+b (c) x"
    long = " ".join(["machine learning and natural language processing"] * 5)
    got = one(spark, lambda t: phrases.with_dictionary(t, rules), long)
    assert got["applied"] and got["text"] == "[DICT] NLP=natural language processing; ML=machine learning\n" + " ".join(["ML and NLP"] * 5)
    for text in ("ML test", "", "machine learning", "__machine learning_1__"):
        assert tuple(one(spark, lambda t: phrases.with_dictionary(t, rules), text)) == (text, False)
    kept = one(spark, lambda t: phrases.with_dictionary(t, {"code": "k"}), "code code code code __CODE_1__ code")
    assert kept["text"].count("__CODE_1__") == 1
    assert one(spark, T.shortened, "by means of it. Do it; it is 5 percent, do not.") == "by it. Do it; it's 5 %, don't."


GOLDEN = [
    ({"items": [{"id": 1, "name": "Alpha"}, {"id": 2, "name": "Beta"}]}, "items[2] id,name\n  1,Alpha\n  2,Beta"),
    ({"note": "  spaced", "flag": "null", "dash": "-start"}, 'note: "  spaced"\nflag: "null"\ndash: "-start"'),
    ({"a": {"b": {"c": 1}}}, "a.b.c: 1"),
    ({"a": {"b": 1}, "a.b": 2}, 'a\n  b: 1\n"a.b": 2'),
    ([{"items": [{"id": 1, "name": "A"}, {"id": 2, "name": "B"}], "tag": "x"}], "[1]\n  - items[2] id,name\n    1,A\n    2,B\n    tag: x"),
    ({"tags": ["admin", "ops", "dev"]}, "tags[3]: admin,ops,dev"),
    ({"e": {}, "l": [], "n": None, "t": True, "f": 2.0, "g": 1.5}, "e: {}\nl[0]\nn: null\nt: true\nf: 2\ng: 1.5"),
    (["a,b", "c"], "[2|]: a,b|c"),
    ([1, [2, "x:y"], {"k": 3}, {}], '[4]\n  - 1\n  - [2]: 2,"x:y"\n  - k: 3\n  - {}'),
    ("a\nb", '"a\\nb"'),
    ([{"Quantity": 1, "DESCRIPTION": "x"}, {"Quantity": 2, "DESCRIPTION": None}], "[2] Qty,DESC\n  1,x\n  2,null"),
]


def test_notation(spark):
    for value, text in GOLDEN:
        assert notation.encode(value) == text
    assert notation.best_delimiter(["a,b", "c"]) == "|"
    rng = np.random.default_rng(1)

    def made(depth):
        kind = rng.integers(0, 5 if depth else 3)
        if kind == 3:
            return {f"some_long_key_{rng.integers(0, 4)}": made(depth - 1) for _ in range(rng.integers(0, 4))}
        if kind == 4:
            return [made(depth - 1) for _ in range(rng.integers(0, 4))]
        return [int(rng.integers(0, 9)), f"a recurring text {rng.integers(0, 3)}", None][kind]

    for _ in range(200):
        value = made(4)
        other, legend = notation.aliases(value)
        assert notation.restored(other, legend) == value
        plain = "\n".join(notation.Layout(notation.laid_out(value)).lines())
        assert len(notation.encode(value)) <= max(len(plain), 1)
        assert notation.put_together(notation.laid_out(value)) == value
    deep = value = []
    for _ in range(5000):
        value = [value]
    assert notation.encode(value).count("\n") == 5000 and deep == []
    rows = spark.createDataFrame([(1, '{"a": [1, 2]}'), (2, "no {"), (3, None), (4, ""), (4, "")], "k long, v string")
    assert sorted(map(str, notation.notated(rows, "k", "v").collect())) == sorted(f"Row(k={k}, v={v!r})" for k, v in [(1, "a[2]: 1,2"), (2, "no {"), (3, None), (4, ""), (4, "")])
    assert notation.notated(rows.where("false"), "k", "v").count() == 0
    assert notation.worth_it([1, 2, 3], 9) and not notation.worth_it({"a": 1}, 9) and notation.worth_it({"a": 1}, 200) and not notation.worth_it("x", 900)


def test_signatures_find_near_documents(spark):
    got = {(r["a"], r["b"]) for r in catalog.queries()["minhash_near_documents"](spark, DATA).collect()}
    docs = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        words = re.sub("[^a-z0-9]+", " ", r["text"].lower()).split()
        if words:
            docs.setdefault(frozenset(" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))), []).append(r["doc_id"])
    sets = sorted((min(ids), s) for s, ids in docs.items())
    want = {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= 0.8 * len(x | y)}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_protect_tags(spark):
    parse = lambda t: one(spark, structure.protected_chunks, t)
    chunks = lambda t: [tuple(c) for c in parse(t)["chunks"]]
    assert chunks("a <protect>b <Protect x=1>c</protect> d</PROTECT> e") == [("text", "a "), ("protected", "b c d"), ("text", " e")]
    assert chunks("") == [] and chunks("plain") == [("text", "plain")] and chunks("<protect></protect>") == [("protected", "")]
    assert [parse(t)["error"] for t in ("a</protect>", "<protect>a", "<protect>a</protect b>", "<protect>a</protect >", "ok")] == ["unopened", "unclosed", "attributes", None, None]


def test_hoisted_lines(spark):
    assert one(spark, structure.hoisted, "\n- Do not run.\nx\n2. Do not run.\nmust go\nDo not run.") == "\n" + structure.HOISTED + "\n- Do not run.\n\nx\nmust go"
    for text in ("Never.\nx", "", f"{structure.HOISTED}\n- Never.\nNever.\nNever.", "__A_1__ never\nnever __A_1__"):
        assert one(spark, structure.hoisted, text) == text


def test_sentence_spans(spark):
    text = "  One two. Three?\n\n four 3.14 \t five"
    got = [text[s["start"] : s["end"]] for s in one(spark, structure.sentence_spans, text)]
    assert got == ["One two.", "Three?", "four 3.", "14 \t five"]
    assert one(spark, structure.sentence_spans, " \n") == [] and [tuple(s) for s in one(spark, structure.sentence_spans, "!!")] == [(0, 2)]


def test_discourse(spark):
    assert one(spark, discourse.blocks, "a\n\n\n\nb") == ["a", "b"] and one(spark, discourse.blocks, "  ") == []
    assert one(spark, discourse.blocks, "# A\nx\n## B\ny") == ["# A\nx", "## B\ny"]
    assert one(spark, discourse.blocks, "Do:\n- a  \n  more\n- b\n \nend") == ["Do:", "- a\n  more", "- b", "end"]
    assert one(spark, discourse.blocks, "pre Key Point: x. Other: y") == ["pre", "Key Point: x.", "Other: y"]
    spans = "array(named_struct('start', 0, 'end', 4, 'label', 'x', 'weight', 0.2D), named_struct('start', 12, 'end', 14, 'label', 'x', 'weight', 2D))"
    row = spark.createDataFrame([("ab __A_1__ cd",)], "t string").select(discourse.piece_weights(F.col("t"), F.expr(spans)).alias("w")).first()["w"]
    assert row == [0.2, 2.0]
    assert one(spark, lambda n: profiles.mode(n), " SAFE ") == "conservative" and one(spark, lambda n: profiles.mode(n), "?") == "maximum"


def test_chats(spark):
    roles = ["system", "user", "assistant", "user", "user", "assistant", "assistant", "tool", "assistant", "user"]
    turns = spark.createDataFrame([(1, k, r, "must " * (9 if k == 3 else 0) + "word " * 60) for k, r in enumerate(roles)] + [(2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["kept"] for r in chats.kept_turns(turns).collect()}
    kept = {t for (c, t), k in got.items() if c == 1 and k}
    assert got[2, 0] and {0, 9, 3, 4, 5} <= kept  # system, last, the best, and the pair that goes with it
    segments = one(spark, chats.segments, "intro\nuser: hi\nthere\n assistant : x\nNote 1: y")
    assert [tuple(s) for s in segments] == [("user", "hi\nthere"), ("assistant", "x"), ("Note 1", "y")]
    assert [tuple(s) for s in one(spark, chats.segments, " plain ")] == [(None, "plain")] and one(spark, chats.segments, "") == []


def test_values_that_must_stay(spark):
    text = "Use REGION=eu-1, REGION=eu-1 on i-0123456789abcdef0 since 2024-01-02"
    values = one(spark, T.hard_values, text)
    assert values == ["REGION=eu-1", "i-0123456789abcdef0", "2024-01-02"]
    add = lambda t, v: spark.createDataFrame([(t, v)], "t string, v array<string>").select(T.with_values(F.col("t"), F.col("v")).alias("x")).first()["x"]
    assert add("Go.", values) == "Go. Include REGION=eu-1, i-0123456789abcdef0, and 2024-01-02."
    assert add("Go", values[:1]) == "Go. Include REGION=eu-1." and add("Go", values[:2]) == "Go. Include REGION=eu-1 and i-0123456789abcdef0." and add(text, values) == text


def test_sources_and_settings(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# note\n\nIn Order = to\nin order\tfor\nb=\n= c\n")
    assert [tuple(r) for r in io.phrase_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("in order", "for")]
    (tmp_path / "d.json").write_text('{"A": "z", "a": "b"}')
    assert [tuple(r) for r in io.phrase_dictionary(spark, str(tmp_path / "d.json")).collect()] == [("a", "b")]
    spark.conf.set("condensa.n", " 7 ")
    spark.conf.set("condensa.x", "?")
    spark.conf.set("condensa.on", "yes")
    assert io.settings(spark, "condensa", {"n": 1, "x": 2.5, "on": False, "gone": "d"}) == {"n": 7, "x": 2.5, "on": True, "gone": "d"}
    history = spark.createDataFrame([(1, "a", "b"), (2, " ", "b"), (3, "c", None), (4, "d", "e")], "id long, raw_prompt string, optimized_prompt string")
    assert [r["id"] for r in io.training_records(history, 2, "id").collect()] == [4, 1]
    rows = spark.createDataFrame([(1, ["a", "b", "a", "c"], ["b", "c"]), (2, None, ["x"]), (3, ["x"], None)], "id long, original array<string>, kept array<string>")
    assert sorted(r["labels"] for r in io.keep_labels(rows, "id").collect()) == [[], [0], [0, 1, 0, 1]]


def test_labels_are_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 25)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        keep = io.longest_common(a, b)
        rest = iter(b)
        assert sum(keep) == best[-1][-1] and all(x in rest for x, k in zip(a, keep) if k)


def test_only_deduplicated(spark, texts):
    sign = lambda t: [re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ") for s in split(t)]

    def plain(before, after):
        x, y = sign(before), sign(after)
        rest = iter(x)
        return 0 < len(y) < len(x) and all(s in rest for s in y) and len(set(x)) < len(x)

    after = {r["doc_id"]: r["text"] for r in catalog.queries()["exact_sentence_dedup"](spark, DATA).collect()}
    got = {r["doc_id"]: r["only"] for r in catalog.queries()["only_deduplicated"](spark, DATA).collect()}
    assert got == {i: plain(texts[i], after[i]) for i in got} and any(got.values())
    for a, b in (("A b. A b. C.", "A b. C."), ("A b. A b. C.", "C. A b."), ("A. B.", "A."), ("A. A.", ""), ("", "A")):
        assert one(spark, dedup.only_deduplicated, a, b) == plain(a, b)


def test_aliases(spark):
    url = "https://example.org/a/long/path"
    for text in (f"see {url} and {url} now", f"see {url}", "", "Note: a\nNote: b\nNote: c\nNote: d", "Ada Lovelace met Ada Lovelace. Ada Lovelace left. R1"):
        for kind in aliases.KINDS:
            got = one(spark, lambda t: aliases.aliased(t, kind), text)
            assert got["legend"] is None and got["text"] == text or len(got["text"]) < len(text)
    got = one(spark, lambda t: aliases.aliased(t, "reference"), f"see {url} and {url} now")
    assert got["text"] == "see R1 and R1 now" and got["legend"] == [f"R1={url}"]
    assert one(spark, lambda t: aliases.restored(t, F.array(F.lit(f"R1={url}"))), "R1, R1 or R12") == f"{url}, {url} or R12"
    assert one(spark, lambda t: aliases.with_legend(t, F.array(F.lit("R1=x")), F.lit(None).cast("array<string>")), "R1") == "R1\nLegend: R1=x"
    assert [tuple(x) for x in spark.createDataFrame([(["b", "a", "b"],)], "x array<string>").select(aliases.counts(F.col("x")).alias("c")).first()["c"]] == [("a", 1), ("b", 2)]


def test_paragraphs_sections_and_gzip(spark):
    text = "one two three four five\n\none two three four five six\n\nother words here\n\none two three four five"
    docs = spark.createDataFrame([(1, text), (2, "a\n\na"), (3, None)], "doc_id long, text string")
    assert [r["kept"] for r in dedup.paragraphs_by_query(docs, "six").orderBy("pos").collect()] == [False, True, True, False]
    assert [r["kept"] for r in dedup.paragraphs_by_query(docs, "zero").orderBy("pos").collect()] == [True, False, True, False]
    long = "# Head\n\n" + "\n\n".join(f"p{k} " + "word " * 20 + ("query" if k == 3 else "") for k in range(6))
    kept = [r["pos"] for r in ranking.section_ranking(spark.createDataFrame([(1, long)], "doc_id long, text string"), "query", 10, 0.4).collect()]
    assert kept[0] == 0 and 4 in kept and len(kept) < 7
    rows = {r["item_id"]: r["score"] for r in ranking.gzip_scores(spark.createDataFrame([(1, "abc " * 50), (2, None), (3, "zq")], "item_id long, text string"), "abc " * 50).collect()}
    assert rows[2] == 0.0 and rows[1] > rows[3]
    with pytest.raises(ValueError):
        ranking.ranked("none")
    with pytest.raises(ValueError):
        ranking.chunked(docs, "none")
    assert ranking.chunked(docs, "off").count() == 3 and ranking.chunked(docs, "fixed").count() == 2


def test_rate_limit_by_a_plain_loop():
    rng = np.random.default_rng(3)
    for most in (0, 1, 3):
        times = np.sort(rng.integers(0, 300, 200)).astype(float)
        want, taken = [], []
        for t in times:
            ok = sum(x > t - 60 for x in taken) < most
            want.append(ok)
            taken += [t] if ok else []
        assert sinks.accepted(times, np.zeros(0), most, 60).tolist() == want


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \n", None), (3, " \n", None)], "doc_id long, text string, source string")
    for f in (dedup.lines, dedup.sentences, dedup.blocks, dedup.redundancy, dedup.kept_sentences, dedup.repeated_windows, dedup.minhashes, dedup.near_documents, ranking.packed_chunks, ranking.luhn, ranking.lexrank, ranking.sentence_entropy, structure.sections, structure.repeated_labels):
        assert f(none).count() == 0
        assert f(odd).count() in (0, 4), f
    assert {(r["doc_id"], r["text"], r["n_removed"]) for r in dedup.lines(odd).collect()} == {(1, None, 0), (2, "", 0), (3, " \n", 0)}
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (9, [0.9, 0.1]), (400, [0.0, 1.0]), (401, [0.1, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ranking.adjacent_groups(vectors).orderBy("vec_id").collect()] == [(5, 1), (9, 1), (400, 2), (401, 2)]
    assert ranking.adjacent_groups(vectors.where("false")).count() == 0
    flights = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 6), (1, 3, 10, 12)], "k int, i int, a int, z int")
    assert {(r["i"], r["slots"]) for r in relational.in_flight(flights, "k", "i", F.col("a"), F.col("z")).collect()} == {(1, 1), (2, 2), (3, 1)}
