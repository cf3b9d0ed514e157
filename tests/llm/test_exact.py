"""Operators with one right result, against plain versions, an exact round trip or the tokenizers themselves."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe, licenses, mixing, ngram_join, quality_rules, queries, substring_dedup, token_counts, winnowing

from . import brute
from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(params=["tables", "odd"])
def case(request, docs, rows, odd, odd_rows):
    return (docs, rows) if request.param == "tables" else (odd, odd_rows)


def test_ngram_join(case):
    df, rows = case
    want = brute.jaccard_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.per_row(df).collect()}
    assert got == want


def near_copies(groups: int, copies: int, seed: int) -> list[tuple[int, str]]:
    """Chains and stars of edited copies around the threshold, dealt over the ids."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        text = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.choice([7, 12, 40, 90]))]
        for _ in range(copies):
            if rng.random() < 0.5:
                text = list(text)
            t = text if rng.random() < 0.3 else list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"e{rng.randrange(5)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_near_the_threshold(spark, seed):
    rows = near_copies(12, 25, seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.per_row(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute.jaccard_components(rows)


def test_ngram_join_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "k l m n o p"), (2, "k l m n o p"), (None, "a b c d e f"), (3, "q")]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in ngram_join.per_row(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", None)]


def test_ngram_join_rows_of_one_id_link_by_themselves(spark):
    fresh = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a, b, c = fresh("a", 8), fresh("b", 30), fresh("c", 12)
    rows = [(1, a), (1, fresh("long", 1000)), (2, a), (9, a), (9, b), (9, c), (9, None), (7, b), (8, c), (8, fresh("d", 400)), (5, b + " x"), (6, fresh("e", 20)), (6, fresh("f", 200)), (4, fresh("f", 200)), (10, ""), (10, None)]
    rng = random.Random(5)
    near = [(100 + rng.randrange(150), t) for _, t in near_copies(8, 25, 3)]
    for case in (rows, near, rows + near):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.per_row(spark.createDataFrame(case, "doc_id long, text string").repartition(5)).collect()}
        assert got == brute.jaccard_components(case)


def joined(spark, rows, parts=5):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.per_row(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}


def test_ngram_join_chain_in_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(ngram_join, "stored", lambda df, tag, f=ngram_join.stored: (tables.append(tag), f(df, tag))[1])
    labels = spark.createDataFrame([(i, i) for i in range(400)], "doc_id long, comp long")
    order = list(range(200))
    random.Random(2).shuffle(order)
    for way in (range(200), order):
        way = list(way)
        tables.clear()
        got = {r["doc_id"]: r["comp"] for r in ngram_join.components(labels, spark.createDataFrame(list(zip(way, way[1:], strict=False)), "a long, b long")).collect()}
        assert got == {i: 0 if i < 200 else i for i in range(400)}
        assert tables.count("links") < 8 and tables.count("hooks") < 25
    # each text keeps all but four of the words of the one before
    rows = [(999 - k, " ".join(f"w{j}" for j in range(4 * k, 4 * k + 60))) for k in range(200)]
    assert joined(spark, rows) == brute.jaccard_components(rows)


def test_ngram_join_templates_and_common_grams(spark, monkeypatch):
    rng = random.Random(9)
    fresh = lambda name, n: [f"{name}{rng.randrange(10**9)}" for _ in range(n)]
    shared, line = fresh("t", 12), fresh("c", 6)
    rows = [" ".join(fresh("a", 50) + shared + fresh("b", 50)) for _ in range(150)]
    rows += [" ".join(shared + fresh("s", k)) for k in (0, 1, 2, 3, 5, 8) for _ in range(8)]
    rows += [" ".join(line * k + fresh("x", j)) for k in (1, 2, 3) for j in range(6) for _ in range(3)]
    base = fresh("n", 80)
    for _ in range(60):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            t[rng.randrange(80)] = fresh("e", 1)[0]
        rows.append(" ".join(t))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute.jaccard_components(rows)
    assert joined(spark, rows) == want
    # lists cut into cells, products held in small pieces, no masked rounds before the product of the index
    for name, value in (("CELL", 7), ("HELD", 64), ("ROUNDS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    assert joined(spark, rows) == want


def test_substring_dedup(case):
    df, rows = case
    got = substring_dedup.digest(substring_dedup.dedup(df)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute.without_repeats(rows))


def test_substring_dedup_random(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        t = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(200)
            t += [f"p{k % 200}" for k in range(a, a + rng.randrange(5, 40))] if rng.random() < 0.7 else [rng.choice("abc") for _ in range(20)]
        rows.append((i, " ".join(t)))
    got = substring_dedup.digest(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute.without_repeats(rows))


def test_fingerprints(case):
    df, rows = case
    want = brute.edits(rows)
    got = winnowing.edit_comparison(df).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    text = dict(rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[text[r["doc_id"]] or ""].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())


def test_winnowing_rule():
    rng = random.Random(3)
    for n in (1, 5, 23, 24, 25, 130, 400, 3000):
        text = "".join(rng.choice("ab") for _ in range(n))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        with np.errstate(over="ignore"):
            h = winnowing.gram_hashes(points, min(24, n)) >> np.uint64(24)
        picked = winnowing.winnow(text)
        assert [int(x) & 0xFFFFFF for x in picked] == brute.winnowed([int(x) for x in h], winnowing.W)


def test_fingerprints_meet_in_short_shared_runs(spark):
    rng = random.Random(6)
    letters = "".join(map(chr, range(0x4E00, 0x5E00)))
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for n in (30, 47, 127, 309):
        shared = fresh(15)
        # the higher id's next is the lower: they share 15 code points and nothing else
        rows = [(2, fresh(n) + shared + fresh(n)), (1, fresh(n // 2) + shared + fresh(n))]
        got = {r["doc_id"]: r for r in winnowing.edit_comparison(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[2]["near_next"] > 0 and got[2]["near_edited"] > 0 and got[1]["near_edited"] > 0
    for n in (15, 16, 30, 47, 127):
        rows = [(2, fresh(n)), (1, fresh(n))]
        got = {r["doc_id"]: r for r in winnowing.edit_comparison(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[2]["near_next"] == 0 and (got[2]["near_edited"] > 0 or n < 30)


def test_bpe(case):
    df, rows = case
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    want = {}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids, skip_special_tokens=False)))
    for made in (bpe.decode(bpe.encode(df, PATH), PATH), bpe.round_trip(df, PATH)):
        assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(made).collect()} == want
    counts = token_counts.count_tokens(df, PATH).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts} == {i: (len((t or "").encode()), want[i][0], want[i][0] > 512) for i, t in rows}


def test_bpe_joins_of_unsplit_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(c) for _ in range(n)) for c in ("ab", "aeinrst", "é中文x", "=-", "the") for n in (10, 500, 6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib = Tokenizer.from_file(PATH)
    for leaf in (16, 64):
        got = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(bpe.decode(bpe.encode(df, PATH, leaf=leaf), PATH)).collect()}
        assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_quality_rules(case):
    df, rows = case
    got = quality_rules.judge(df).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got} == {i: brute.quality_base(t) for i, t in rows}
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_mixing(case):
    df, rows = case
    got = mixing.taken(df).collect()
    source = {r["doc_id"]: r["source"] for r in df.select("doc_id", "source").collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t in rows}
    totals, taken = Counter(), Counter()
    for i, n in size.items():
        totals[source[i]] += n
    targets = brute.sources_targets(totals)
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in got} == {i: (n, totals[source[i]]) for i, n in size.items()}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(targets[source[r["doc_id"]]])
    assert all(abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK for s in targets)
    assert sorted(mixing.taken(df.repartition(3)).collect()) == sorted(got)


def test_mixed_documents(docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
    assert words == Counter({i: n for i, n in taken.items() if n})


def test_mixed_documents_of_repeated_rows(spark):
    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a, b = text("a", 300), text("b", 400)
    rows = [(1, a, "x", "p"), (1, a, "x", "q"), (2, b, "x", "p"), (None, a, None, "p"), (None, a, None, "p"), (None, b, None, "p"), (3, None, "x", "p"), (1, a, "y", "p"), (4, "", "z", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    taken, words = Counter(), Counter()
    for r in mixing.taken(df).collect():
        taken[r["doc_id"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for r in mixing.mixed_documents(df).collect():
        words[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
    assert words == Counter({i: n for i, n in taken.items() if n})


def test_mixing_targets_of_many_sources(spark):
    rng = random.Random(7)
    totals = {f"s{k:04d}": rng.choice([0, 1, 5, 100, 10_000, 1_000_000]) for k in range(500)} | {None: 77}
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(list(totals.items()), "source string, size long")).collect()}
    want = brute.sources_targets(totals)
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)
    docs = [(k, "w " * (k % 90), f"s{k % 300}") for k in range(1500)]
    taken = Counter()
    for r in mixing.taken(spark.createDataFrame(docs, "doc_id long, text string, source string"), block=8).collect():
        taken[f"s{r['doc_id'] % 300}"] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    sizes = Counter()
    for k, t, s in docs:
        sizes[s] += k % 90
    aims = brute.sources_targets(sizes)
    assert all(abs(taken[s] - aims[s]) <= 16 for s in aims)


def test_licenses(case):
    df, rows = case
    got = licenses.digest(licenses.scan(df)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got} == {i: brute.license_base(t) for i, t in rows}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_templates():
    scanner = licenses.Scanner({"t": ["we [do {2} really] grant [a|the] permission"]}, {})
    for text, ok in (("we grant permission", True), ("We do, really: grant the permission!", True), ("we do x y really grant a permission", True), ("we do x y z really grant permission", False), ("we grant our permission", False)):
        assert (scanner(text)[5] == "t") == ok, text
    whole = licenses.TEMPLATES["isc-text"][0].replace("[or]", "or")
    assert licenses.Scanner()("# " + whole.upper())[5] == "isc-text"
    assert licenses.Scanner()(whole.replace("fee", "charge"))[5] == ""


def test_license_template_of_alternatives():
    scanner = licenses.Scanner({"m": ["mit | x11"], "n": ["[a|b] c"]}, {})
    assert scanner("under x11 now")[5] == "m" and scanner("b c")[5] == "n" and scanner("nothing")[5] == ""


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op2_fingerprints", "op6_quality_rules", "op7_mixing", "op8_substring_dedup", "op10_licenses"])
def test_queries_against_their_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(map(tuple, df.select(*cols).collect())) == plain(duck.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall())


def test_repeated_rows_are_judged_each_by_itself(spark):
    rows = [(1, "the mit license of a b c"), (1, "the mit license of a b c"), (None, "x y"), (None, "x y"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (quality_rules.judge, licenses.scan, winnowing.edit_comparison, winnowing.fingerprints, substring_dedup.dedup, lambda d: bpe.digests(bpe.decode(bpe.encode(d, PATH), PATH)), lambda d: token_counts.count_tokens(d, PATH)):
        got = [r["doc_id"] for r in f(df).collect()]
        assert sorted(map(str, got)) == ["1", "1", "2", "None", "None"]


def test_empty_tables(empty):
    for f in (ngram_join.per_row, substring_dedup.dedup, winnowing.edit_comparison, winnowing.fingerprints, quality_rules.judge, mixing.taken, mixing.mixed_documents, licenses.scan, lambda d: bpe.digests(bpe.decode(bpe.encode(d, PATH), PATH)), lambda d: token_counts.count_tokens(d, PATH)):
        assert f(empty).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 5, 6, 13])
def test_automaton_covers_windows_of_smaller_owners(length):
    rng = np.random.default_rng(length)
    for _ in range(60):
        letters = int(rng.integers(1, 5))
        draw = lambda n: [b"abcd"[c : c + 1] for c in rng.integers(0, letters, n)]  # noqa: E731, B023
        spans = [(int(rng.integers(0, 4)), draw(int(rng.integers(length, 3 * length + 2)))) for _ in range(3)]
        words = draw(40) + spans[0][1] + draw(7) + spans[1][1][: length + 1] + draw(3)
        auto = substring_dedup.SuffixAutomaton(length)
        for owner, span in spans:
            auto.add(span, owner)
        auto.close()
        known = {tuple(span[i : i + length]) for owner, span in spans if owner < 2 for i in range(len(span) - length + 1)}
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if tuple(words[i : i + length]) in known:
                gone[i : i + length] = [True] * length
        assert auto.covered(words, 2).tolist() == gone
