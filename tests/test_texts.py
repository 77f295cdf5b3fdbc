"""Tables of phrases, JSON in prose, constraints, fragments, macros, factoring, chunks and caches against plain versions."""

import itertools
import json
import random
import re
import time
from collections import OrderedDict, defaultdict

import pytest
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import chunks, constraints, factoring, fragments, jsontext, macros, paraphrases, phrases
from condensa.streaming import cache

DOCS = "doc_id long, text string, part int, kind string, units string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 0, "x", "y") for i, t in enumerate(texts)], DOCS)


# --- tables of phrases


def plain_replaced(text, rules):
    wordy = lambda c: re.match(r"[^\W]", c) is not None or c == "_"
    rules, out, i, n = {k.lower().strip(): v for k, v in rules.items() if k and k.strip()}, [], 0, 0
    while i < len(text):
        fits = [k for k in rules if text[i : i + len(k)].lower() == k and not (i and wordy(text[i - 1]) and wordy(text[i])) and not (i + len(k) < len(text) and wordy(text[i + len(k)]) and wordy(text[i + len(k) - 1]))]
        fits = [k for k in fits if (wordy(k[0]) or not i or not wordy(text[i - 1])) and (wordy(k[-1]) or i + len(k) == len(text) or not wordy(text[i + len(k)]))]
        if fits:
            k = max(fits, key=len)
            out.append(phrases._as_found(text[i : i + len(k)], rules[k]))
            i, n = i + len(k), n + 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out), n


def test_tables_of_phrases_by_brute_force(spark):
    rng = random.Random(3)
    rules = {"a b": "ab", "b": "x", "b a b": "Long", "é": "e", "c++": "cpp", "-a": "minus", "B c": "Bc-Form", "": "no", "  ": "no", "a b c d": "four"}
    texts = ["".join(rng.choice(["a", "b", "c", "d", "é", " ", " ", "++", "-", "A", "B", "_", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(600)] + [None, "", "A B C D", "x" * 100_000 + " a b"]
    table = spark.createDataFrame([*rules.items(), (None, "n"), ("A B", "zz"), ("gone", None)], "phrase string, canonical string")
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in phrases.replaced_by_table(docs_of(spark, [*texts, "it is gone."]), table).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ((None, 0) if t is None else plain_replaced(t, rules)), t
    assert got[len(texts)] == ("it is .", 1)
    assert phrases.replaced_by_table(docs_of(spark, texts).limit(0), table).count() == 0
    assert {r["n_replaced"] for r in phrases.replaced_by_table(docs_of(spark, texts), table.limit(0)).collect()} == {0}


def test_a_trie_of_fifty_thousand_phrases():
    words = [f"w{i % 700}" for i in range(60_000)]
    rng = random.Random(1)
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60_000)})[:50_000]
    trie = phrases.Trie(names)
    assert trie.key.nbytes + trie.to.nbytes + trie.phrase.nbytes < 16_000_000
    import numpy as np

    for name in rng.sample(names, 200):
        units = np.array([trie.unit[u] for u in re.findall(r"\w+|\W", name)])
        size, found = trie.longest(units, np.arange(len(units), 0, -1), np.ones(len(units), bool), np.ones(len(units), bool))
        assert size[0] == len(units) and names[found[0]] == name


def test_too_large_a_table_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_PHRASES", 1)
    table = spark.createDataFrame([("a", "b"), ("c", "d")], "phrase string, canonical string")
    with pytest.raises(ValueError, match="at most 1"):
        phrases.replaced_by_table(docs_of(spark, ["a"]), table)


# --- JSON in prose


def test_blocks_are_what_decoding_at_every_brace_finds():
    rng = random.Random(2)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"', "1", "-2.5e3", "01", "true", "nul", "null", " ", "\n", "x", '"\\n"', '"\\q"', '{"k": [1, {"z": "q"}]}', "[]", "{}", '"{}"']
    decode = json.JSONDecoder().raw_decode
    for _ in range(20_000):
        text, at, want = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), 0, []
        while at < len(text):
            try:
                end = decode(text, at)[1] if text[at] in "{[" else 0
            except ValueError:
                end = 0
            want += [(at, end)] if end else []
            at = end or at + 1
        assert list(jsontext.blocks(text)) == want
    assert list(jsontext.blocks("[" * 50_000)) == []
    assert list(jsontext.blocks("[" * 50_000 + "]" * 50_000)) == [(0, 100_000)]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("a.*.c", "a b c", True), ("**", "", True), ("**.c", "a b c", True), ("a.**", "a", True), ("", "", True), ("", "a", False), ("a", "a b", False), ("**.b.**", "a b", True), ("a.+", "a x", False)])
def test_paths(pattern, path, fits):
    assert bool(jsontext.path_pattern(pattern).match("".join(f"\x00{p}" for p in path.split()))) == fits


def test_parts_join_to_the_text_again(spark):
    value = {"a": ["x\n\"q\"", {"b": "\x01é"}], "c": {"keep": "k", "n": 1.50}}
    texts = [f"say {json.dumps(value)} and [1, 2] {{open", None, "", "no brace", '{"half": "\\ud800", "a": 1e5}', json.dumps(value) * 2]
    policy = {"default": True, "overrides": {"c.**": False, "a.0": True}}
    rows = jsontext.parts(docs_of(spark, texts), policy)
    kinds = [(r["kind"], r["path"], r["text"]) for r in rows.where("doc_id = 0").orderBy("part").collect()]
    assert [k for k in kinds if k[0] == "string"] == [("string", "a.0", 'x\n"q"'), ("string", "a.1.b", "\x01é")]
    got = {r["doc_id"]: r["text"] for r in jsontext.joined(rows).collect()}
    assert set(got) == {0, 2, 3, 4, 5} and got[2] == "" and got[3] == "no brace" and got[4] == '{"half":"\\ud800","a":1e5}'
    assert got[0].startswith('say {"a":') and got[0].endswith("} and [1,2] {open") and '"n":1.5' in got[0]
    assert json.loads(got[0][4 : got[0].index("} and") + 1]) == value


# --- forced spans and fingerprints


def test_forced_spans_by_a_plain_loop(spark):
    rng = random.Random(4)
    patterns = {"word": "ab+", "mark": "__[A-Z]+_[0-9]+__", "pair": "b[a-z]"}
    texts = ["".join(rng.choice(["a", "b", "bb", "c", "1", "-", "_", "é", "__X_1__"]) for _ in range(rng.randint(0, 20))) for _ in range(300)] + [None]
    want = set()
    for i, t in enumerate(texts):
        found = [(m.start(), -len(m[0]), k, n, m[0]) for k, (n, p) in enumerate([*patterns.items(), ("digits", constraints.DIGITS)]) for m in re.finditer(p, t or "") if not re.fullmatch(phrases.PLACEHOLDER, m[0])]
        upto = 0
        for start, less, _, name, value in sorted(found):
            if start >= upto:
                upto = start - less
                want.add((i, name, start, upto, value))
    assert {tuple(r) for r in constraints.forced_spans(docs_of(spark, texts), patterns).collect()} == want
    with pytest.raises(ValueError, match="no pattern"):
        constraints.forced_spans(docs_of(spark, []), {}, digits=False)


def test_fingerprints_and_their_violations(spark):
    said = ['You must include exactly 3 bullet points. Do not mention "beta". You should keep each bullet under 20 words and never use passive voice.', "You must provide exactly 2 examples for the final answer and do not use emojis.", "Do not expose API keys in the response.", "No.", None, ""]
    prints = constraints.fingerprint(docs_of(spark, said))
    kinds = defaultdict(set)
    for r in prints.collect():
        kinds[r["doc_id"]].add(r["kind"])
    assert kinds[0] == {"must", "should", "do_not", "negation", "quoted", "numeric"} and 4 not in kinds and 5 not in kinds
    assert [r["said"] for r in prints.where("kind = 'quoted'").collect()] == ["beta"]
    now = ["Include 2 bullets.", "Must provide exactly 2 examples for the final answer. Do not use emojis.", "Expose API keys in the response.", None, "x", "y"]
    bad = {(r["doc_id"], r["kind"], r["severity"]) for r in constraints.violations(prints, docs_of(spark, now)).collect()}
    assert {x for x in bad if x[0] in (1, 4, 5)} == set()
    assert {(0, "quoted", "mandatory"), (0, "numeric", "mandatory"), (2, "negation", "mandatory"), (2, "do_not", "mandatory"), (3, "negation", "mandatory")} <= bad and (0, "must", "mandatory") not in bad


# --- fragments, macros, factoring


def plain_fragments(tokens, least):
    places = defaultdict(list)
    for i in range(len(tokens) - least + 1):
        places[tuple(tokens[i : i + least])].append(i)
    out = []
    for p in places.values() if len(tokens) >= 2 * least else ():
        size = least
        while len(p) > 1 and all(x + size < len(tokens) for x in p) and len({tokens[x + size] for x in p}) == 1:
            size += 1
        if len(p) > 1:
            out.append((p[0], len(p), size, p))
    return sorted(out)


def plain_cuts(tokens, least):
    kept, gone, cut = set(), set(), []
    for first, _, size, places in sorted(plain_fragments(tokens, least), key=lambda f: (-f[1], -f[2], f[0])):
        if gone & set(range(first, first + size)):
            continue
        kept |= set(range(first, first + size))
        for p in places[1:]:
            if not (kept | gone) & set(range(p, p + size)):
                gone |= set(range(p, p + size))
                cut.append((p, p + size))
    return sorted(cut)


def test_fragments_by_brute_force(spark):
    rng = random.Random(5)
    for _ in range(800):
        tokens, least = [rng.choice("abc") if rng.random() < 0.6 else "x" for _ in range(rng.randint(0, 60))], rng.choice([2, 3, 5])
        begin, count, size, _ = fragments.fragments(tokens, least)
        assert sorted(zip(begin.tolist(), count.tolist(), size.tolist())) == [f[:3] for f in plain_fragments(tokens, least)]
        assert fragments.later_copies(tokens, least) == plain_cuts(tokens, least)
    passage = " ".join(f"w{i}" for i in range(30))
    rows = {r["doc_id"]: (r["text"], r["n_removed"]) for r in fragments.without_copies(docs_of(spark, [f"{passage}\none {passage} two", None, "", "a  b"])).collect()}
    assert rows == {0: (f"{passage}\none  two", 30), 1: (None, 0), 2: ("", 0), 3: ("a  b", 0)}
    tokens = [str(rng.randint(0, 50_000)) for _ in range(30_000)] * 3
    begun = time.time()
    assert sum(b - a for a, b in fragments.later_copies(tokens, 15)) == 60_000 and time.time() - begun < 10


def test_macros_restore_and_never_lose(spark):
    rng = random.Random(6)
    phrase = ["the quick brown fox", "as soon as possible", "user account settings page"]
    texts = [" ".join(x for _ in range(12) for x in (rng.choice(phrase), rng.choice(["and", "or", "é", "1", "so."]))) for _ in range(30)] + [None, "", "[A] the quick brown fox the quick brown fox", f"the quick brown fox {macros.JOINT} the quick brown fox", "Macros: x"]
    rows = macros.with_macros(docs_of(spark, texts)).withColumn("back", macros.restored(F.col("text"), F.col("legend"))).withColumn("n", T.n_tokens(F.col("text"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["back"] == text and r["saved"] >= 0
        assert r["saved"] == 0 or len(re.findall(r"[A-Za-z0-9_']+", text)) - r["n"] == r["saved"]
    assert sum(r["saved"] > 0 for r in rows) > 20
    a, b = "abcdefgh", "ijklmnop"
    assert macros.best_pairs(spark.createDataFrame([(a, b, 5, 68), (b, "c", 9, 60), ("c", "d", 3, 8)], "a string, b string, n long, saved long")) == [(a, b), ("c", "d")]


def test_cuts_save_as_much_as_exhaustive_search():
    rng = random.Random(7)

    def saved(rows):
        best = 0
        for side in (1, -1):
            turned = [w[::side] for w in rows]
            k = 0
            while k < min(map(len, turned)) - 1 and len({w[k] for w in turned}) == 1:
                k += 1
            best = max(best, k * (len(rows) - 1) if k >= 2 and len(rows) >= 3 else 0)
        return best

    for _ in range(150):
        items = [[rng.choice("abc") if rng.random() < 0.3 else "a" for _ in range(rng.randint(2, 6))] for _ in range(rng.randint(1, 9))]
        ways = ([0, *(i + 1 for i, cut in enumerate(cuts) if cut), len(items)] for cuts in itertools.product([0, 1], repeat=len(items) - 1))
        assert factoring.best_cuts(items)[0] == max(sum(saved(items[a:b]) for a, b in itertools.pairwise(at)) for at in ways)


@pytest.mark.parametrize("bullets", [False, True])
def test_factored_lines_expand_to_the_text(spark, bullets):
    rng = random.Random(8)
    lines = ["", "x y", "Order one of: two is {}", "Order one of: two was {} x", "{} is the end of it", "- item of the kind {}", "* item of the kind {}", "1. item of the kind 3", "a; b", "x / y", "k + v w", "a  b", "a b x: y{}", "tail: {} is the: end", "é é {}\r"]
    texts = ["\n".join(rng.choice(lines).format(rng.randint(0, 30)) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, ""]
    rows = factoring.factored_lines(docs_of(spark, texts), bullets).collect()
    assert sum(len(r["marks"]) for r in rows) > 3
    for r in rows:
        assert r["text"] is None if texts[r["doc_id"]] is None else factoring.expanded(r["text"], [m.asDict() for m in r["marks"]]) == texts[r["doc_id"]]


# --- chunks


def test_chunks_come_back_at_every_size(spark):
    texts = [". ".join(f"s{i} w" for i in range(n)) + end for n in (0, 1, 2, 5, 17) for end in ("", ".", ". ", "\n")] + [None]
    docs = docs_of(spark, texts)
    for size, overlap in [(1, 0), (2, 1), (3, 2), (4, 3), (7, 1), (50, 3)]:
        if overlap == 0:
            continue
        got = {r["doc_id"]: r["text"] for r in chunks.fan_in(chunks.fan_out(docs, size, overlap)).collect()}
        assert got == {i: t for i, t in enumerate(texts) if t is not None}, (size, overlap)
    pieces = spark.createDataFrame([(1, 0, "A. B. C"), (1, 1, "B. C. D"), (1, 2, "E\n"), (1, 3, "F"), (1, 4, None), (1, 5, "F"), (2, 0, "x")], "doc_id long, chunk int, text string")
    assert {r["doc_id"]: r["text"] for r in chunks.fan_in(pieces).collect()} == {1: "A. B. C. D\n\nE\nF", 2: "x"}
    with pytest.raises(ValueError, match="fit"):
        chunks.fan_out(docs, 2, 2)


def test_placeholders_are_numbered_over_all_chunks(spark):
    pieces = spark.createDataFrame([(1, 0, "__N_3__ a __N_0__ __N_3__"), (1, 1, "__N_0__ __Q_7__"), (1, 2, "none"), (2, 0, "__N_5__"), (2, 1, None)], "doc_id long, chunk int, text string")
    got = {(r["doc_id"], r["chunk"]): r["text"] for r in chunks.renumbered(pieces).collect()}
    assert got == {(1, 0): "__N_0__ a __N_1__ __N_0__", (1, 1): "__N_2__ __Q_0__", (1, 2): "none", (2, 0): "__N_0__", (2, 1): None}


# --- state


def plain_cache(calls, most, ttl):
    lanes, out = defaultdict(OrderedDict), []
    for lane, seq, digest, now in sorted(calls):
        held, evicted = lanes[lane], None
        expires = held.pop(digest, 0)
        if hit := expires > now:
            held[digest] = expires
        else:
            if len(held) >= most:
                evicted = held.popitem(last=False)[0]
            held[digest] = now + ttl
        out.append((lane, seq, digest, "hit" if hit else "miss", evicted))
    return sorted(out)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def streamed(spark, make, folder, schema, out):
    """All rows that make(stream of the folder's files) has appended to out so far. One batch a call: with timers of the clock
    a stream that runs until nothing is left to do doesn't end."""
    rows = spark.readStream.schema(schema).json(str(folder))
    make(rows).writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(once=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{out}/rows").collect()), key=str)


def test_cache_by_a_plain_loop_with_a_restart(rocks, tmp_path):
    rng = random.Random(9)
    calls = [(lane, seq, f"d{min(rng.randint(0, 9), rng.randint(0, 9))}", seq * 100) for lane in range(3) for seq in range(120)]
    (tmp_path / "in").mkdir()
    write = lambda name, low, high: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("lane", "seq", "digest", "ms"), c))) for c in calls if low <= c[1] < high))
    make = lambda rows: cache.cached(rows, 4, 2_000_000)
    schema = "lane long, seq long, digest string, ms long"
    write("a.json", 0, 50)
    streamed(rocks, make, tmp_path / "in", schema, tmp_path)
    write("b.json", 50, 90)
    streamed(rocks, make, tmp_path / "in", schema, tmp_path)
    write("c.json", 90, 120)  # a new run goes on with what the first has left
    want = plain_cache(calls, 4, 2_000_000)
    assert streamed(rocks, make, tmp_path / "in", schema, tmp_path) == sorted(want, key=str)
    assert {w[3] for w in want} == {"hit", "miss"} and any(w[4] for w in want)


def test_cache_expires_by_the_calls_time(rocks, tmp_path):
    calls = [(0, i, f"d{i % 3}", i * 400) for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("lane", "seq", "digest", "ms"), c))) for c in calls))
    got = streamed(rocks, lambda rows: cache.cached(rows, 8, 3_000), tmp_path / "in", "lane long, seq long, digest string, ms long", tmp_path)
    assert got == sorted(plain_cache(calls, 8, 3_000), key=str) and {g[3] for g in got} == {"hit", "miss"}


# --- paraphrases


def plain_chosen(parts, stays, threshold):
    """All pairs of kept parts instead of bands."""
    out, kept = list(parts), {}
    for i, part in enumerate(parts):
        words = re.findall("[a-z0-9]+", part.lower())
        if stays[i] or len(words) < paraphrases.WORDS:
            continue
        pairs = set(zip(words, words[1:]))
        near = [j for j, (p, w) in sorted(kept.items()) if len(p & pairs) >= threshold * len(p | pairs) and len(w & set(words)) >= paraphrases.OVERLAP * min(len(w), len(set(words)))]
        if not near:
            kept[i] = (pairs, set(words))
            continue
        out[i] = None
        if len(part) < len(out[near[0]]):
            out[near[0]], kept[near[0]] = part, (pairs, set(words))
    return out


def test_paraphrases_against_all_pairs(spark):
    rng, texts, lost, met = random.Random(10), [], 0, 0
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(120):
        base = [rng.choices(vocabulary, k=rng.randint(4, 20)) for _ in range(6)]
        made = [[w for w in rng.choice(base) if rng.random() > 0.05] for _ in range(25)]
        texts.append(" ".join(" ".join(w).capitalize() + rng.choice([".", "!"]) for w in made if w))
    rows = {r["doc_id"]: (r["text"], r["n_removed"]) for r in paraphrases.without_paraphrases(docs_of(spark, [*texts, None, "", "One. One."])).collect()}
    for i, text in enumerate(texts):
        parts = re.split(r"(?<=[.!?]) ", text)
        want = plain_chosen(parts, [False] * len(parts), 0.75)
        n = sum(x is None for x in want)
        lost, met = lost + abs(n - rows[i][1]), met + n
        if n == rows[i][1]:
            assert rows[i][0] == " ".join(x for x in want if x is not None)
    assert met > 500 and lost <= 0.02 * met
    assert rows[120] == (None, 0) and rows[121] == ("", 0) and rows[122] == ("One. One.", 0)
    must = "You must always keep this long sentence of many words in it. " * 3
    assert paraphrases.without_paraphrases(docs_of(spark, [must])).first()["n_removed"] == 0


def test_the_pass_after_chunks(spark):
    block = " ".join(f"word{i}" for i in range(300))
    texts = ["\n\n".join([block, "other " * 500, block + " more", block]), "\n\n".join([block] * 2), "\n\n".join([block + " __X_0__"] * 6), None]
    rows = {r["doc_id"]: r["n_removed"] for r in paraphrases.after_chunks(docs_of(spark, texts)).collect()}
    assert rows == {0: 2, 1: 0, 2: 0, 3: 0}


def test_the_reaper_fails_what_says_nothing(rocks, tmp_path):
    (tmp_path / "in").mkdir()

    def run(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("job", "seq", "status"), r))) for r in rows))
        jobs = cache.reaped(rocks.readStream.schema("job long, seq long, status string").json(str(tmp_path / "in")), 500)
        keep = lambda batch, _: batch.write.mode("append").parquet(str(tmp_path / "rows"))
        jobs.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(once=True).start().awaitTermination()
        return sorted(map(tuple, rocks.read.parquet(str(tmp_path / "rows")).collect()))

    first = run("a.json", [(1, 1, "queued"), (1, 2, "running"), (2, 1, "done"), (3, 1, "running")])
    assert first == [(1, "running"), (2, "done"), (3, "running")]
    time.sleep(1)
    second = run("b.json", [(3, 2, "done"), (2, 2, "running")])
    # the first job fails by the clock, the second has ended before, the third says so in time or has failed just then
    assert (1, "failed") in second and (2, "failed") not in second and [x for x in second if x[0] == 2] == [(2, "done")] * 2
