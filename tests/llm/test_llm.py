"""Text operators against installed encoders, brute force and small exact cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import mixture, queries, repetition, tokenizer

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return tokenizer.PerfectHash(tokenizer.read_ranks())


def test_perfect_hash_is_minimal_and_exact(table):
    ranks = tokenizer.read_ranks()
    assert len(table.keys) == len(ranks) and all(table.get(k) == v for k, v in ranks.items())
    rng = random.Random(1)
    for _ in range(2000):
        b = rng.randbytes(rng.randint(0, 12))
        assert table.get(b) == ranks.get(b, -1)


def test_every_token_is_what_merging_gives(table):
    assert all(tokenizer.merge(k, table) == [v] for k, v in tokenizer.read_ranks().items())


def test_encoding_equals_public_encoders(table):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_ranks(), special_tokens={})
    rng = random.Random(2)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "1", "23", "é", "日本", "<|endoftext|>", "'s", "'ll", "́", "🙂", "\u0000", "�", "!", "...", "ß"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)] + ["a" * 50_000, " " * 5000, "日" * 3000, "ab" * 20_000]
    e = tokenizer.Encoder(table)
    for t in texts:
        assert e.encode(t) == enc.encode_ordinary(t)
        assert enc.decode(e.encode(t)) == t
    assert e.encode("") == e.encode(None) == []


def test_encoding_of_a_table(spark, table):
    e = tokenizer.Encoder(table)
    df = spark.createDataFrame([(2**60 + 1, "Hello world"), (2, ""), (3, None), (None, " x"), (2, "x <|endoftext|>")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in tokenizer.encode_corpus(df).collect())
    assert got == sorted([(2**60 + 1, e.encode("Hello world")), (2, []), (3, []), (0, e.encode(" x")), (2, e.encode("x <|endoftext|>"))])
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0
    named = tokenizer.encode_corpus(df.withColumn("doc_id", F.lit("d")))
    assert dict(named.dtypes)["doc_id"] == "string"


def plain_share(text, span=40):
    s = "".join(c for c in (text or "").lower() if c.isalnum())
    seen, hit = set(), [False] * len(s)
    for i in range(len(s) - span + 1):
        g = s[i : i + span]
        if g in seen:
            hit[i : i + span] = [True] * span
        seen.add(g)
    return sum(hit) / len(s) if s else 0.0


def odd_texts():
    rng = random.Random(3)
    words = ["spam", "Über", "日本", "x1", "...", "A_b", "\n"]
    out = [None, "", " ", "a" * 40, "a" * 41, "ab" * 30, "a" * 100_000, "x" * 39 + "y" + "x" * 39]
    for _ in range(200):
        block = " ".join(rng.choices(words, k=rng.randint(1, 30)))
        out.append(" ".join([block] * rng.randint(1, 4) + rng.choices(words, k=rng.randint(0, 60))))
    return out


def test_share_against_brute_force():
    for t in odd_texts():
        if t is None or len(t) < 50_000:
            assert repetition.repeated_share(repetition.reduce_text(t)) == pytest.approx(plain_share(t))
    assert repetition.repeated_share("a" * 100_000) == pytest.approx(1 - 1e-5)


def test_rules_never_reject_a_case():
    for at_least in (0.1, 0.3, 0.9):
        for t in odd_texts():
            s = repetition.reduce_text(t)
            if s and repetition.repeated_share(s) >= at_least:
                assert not any(rule(s, at_least) for rule in repetition.rules().values())


def test_rule_order():
    names = ["slow", "fast", "useless"]
    measured = [[(1.0, True), (0.1, i % 2 == 0), (0.01, False)] for i in range(10)]
    assert repetition.order_rules(measured, names) == ["fast", "slow"]
    assert repetition.order_rules([], names) == ["slow"]


def test_a_task_measures_then_orders():
    c = repetition.Cascade(0.3, 40, sample=5)
    texts = [repetition.reduce_text(t) for t in odd_texts() if t and len(t) < 50_000]
    for t in texts:
        assert not (c.rejects(t) and t and repetition.repeated_share(t) >= 0.3)
    assert c.order is not None and len(c.measured) == 5


def test_cascade_gives_the_same_cases(spark):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string").withColumn("share", F.lit("clash"))
    every = {r["doc_id"]: r["share"] for r in repetition.repetition(docs).collect()}
    cases = {r["doc_id"]: r["share"] for r in repetition.repetition(docs, at_least=0.3).collect()}
    assert len(every) == docs.count() and cases == {i: s for i, s in every.items() if s >= 0.3} and len(cases) > 20
    assert repetition.repetition(docs.limit(0), at_least=0.3).count() == 0
    assert repetition.repetition(docs.where("text IS NULL"), at_least=0.3).count() == 0


def test_queries_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    assert {r["doc_id"] for r in queries.p10_found(spark, D).collect()} == {d["doc_id"] for d in docs if plain_share(d["text"]) >= 0.3}
    assert queries.p8_ids(spark, D).count() == len(docs)


def test_flow_routes_overlap_to_the_scarce_source():
    flow, total = mixture.route({("a",): 100, ("a", "b"): 100}, {"a": (0.5, 1), "b": (0.5, 1), "c": (0.5, 2)})
    assert total == 200 and flow == {(("a",), "a"): 100, (("a", "b"), "b"): 100}


def test_flow_repeats_only_where_needed_and_up_to_the_cap():
    flow, total = mixture.route({("a",): 100, ("b",): 1000}, {"a": (0.5, 3), "b": (0.5, 1)}, keep_shares=True)
    assert total in (600, 601) and flow[("a",), "a"] == 300
    flow, total = mixture.route({("a",): 100, ("b",): 1000}, {"a": (0.5, 3), "b": (0.5, 1)})
    assert total == 1100 and flow == {(("a",), "a"): 300, (("b",), "b"): 800}
    # a text of both sources is used once before texts of one source are used twice
    flow, _ = mixture.route({("a",): 100, ("a", "b"): 100, ("b",): 100}, {"a": (0.5, 3), "b": (0.5, 3)}, total=300)
    assert sum(n for (p, s), n in flow.items() if p == ("a", "b")) == 100 and sum(flow.values()) == 300


def test_a_scarce_source_does_not_starve_the_others():
    flow, total = mixture.route({("a",): 10**9, ("b",): 10**9, ("c",): 10}, {"a": (0.49, 1), "b": (0.49, 1), "c": (0.02, 4)})
    assert total == 2 * 10**9 + 10 and sum(flow.values()) == total
    assert flow == {(("a",), "a"): 999_999_985, (("b",), "b"): 999_999_985, (("c",), "c"): 40}


def brute_least_cost(patterns, targets, quota):
    """Token by token: the least cost of any flow with these quotas, by Bellman-Ford augmentation of single tokens."""
    flow = {}
    for s, n in quota.items():
        for _ in range(n):
            best = {s: (0, None)}  # cheapest way to free a token for s: through exchanges to a pattern with room
            edges = [(k, j, p) for p in patterns for k in p for j in p if k != j and flow.get((p, j), 0) > 0]
            for _ in range(len(targets)):
                for k, j, p in edges:
                    if k in best and best[k][0] < best.get(j, (1 << 60, None))[0]:
                        best[j] = (best[k][0], (k, p))
            ways = []
            for p, n_p in patterns.items():
                used = sum(flow.get((p, k), 0) for k in p)
                if used < n_p * min(targets[k][1] for k in p):
                    ways += [((used // n_p) ** 2, p, k) for k in p if k in best]
            _, p, k = min(ways)
            flow[p, k] = flow.get((p, k), 0) + 1
            while best[k][1] is not None:
                to, by = best[k][1]
                flow[by, k] -= 1
                flow[by, to] = flow.get((by, to), 0) + 1
                k = to
    return _cost(patterns, flow)


def _cost(patterns, flow):
    total = 0
    for p, n_p in patterns.items():
        used = sum(n for (q, _), n in flow.items() if q == p)
        total += sum((t // n_p) ** 2 for t in range(used))
    return total


def test_flow_has_the_least_cost_and_fair_quotas():
    rng = random.Random(6)
    for _ in range(40):
        names = "abcd"
        patterns = {p: rng.randint(1, 12) for p in sorted({tuple(sorted(rng.sample(names, rng.randint(1, 3)))) for _ in range(6)})}
        targets = {s: (rng.choice([0.1, 0.2, 0.4]), rng.randint(1, 4)) for s in names}
        flow, total = mixture.route(patterns, targets, total=rng.randint(1, 60))
        quota = {}
        for (p, s), n in flow.items():
            assert s in p
            quota[s] = quota.get(s, 0) + n
        for p, n_p in patterns.items():
            assert sum(n for (q, _), n in flow.items() if q == p) <= n_p * min(targets[s][1] for s in p)
        most = sum(n * min(targets[s][1] for s in p) for p, n in patterns.items())
        assert sum(quota.values()) == min(total, most)
        assert _cost(patterns, flow) == brute_least_cost(patterns, targets, quota)
        # no source can gain a token from one that is better off relative to its target
        for s in quota:
            for t in {x for p in patterns for x in p}:
                if (quota[s] - 1) / targets[s][0] > (quota.get(t, 0) + 1) / targets[t][0] + 1e-9:
                    more = quota | {s: quota[s] - 1, t: quota.get(t, 0) + 1}
                    member = np.array([[x in p for x in sorted(more)] for p in patterns])
                    f = mixture.Flow(member)
                    want = np.array([more[x] for x in sorted(more)])
                    f.fill(np.array([n * min(targets[x][1] for x in p) for p, n in patterns.items()]), want)
                    assert (f.flow.sum(0) < want).any()


def test_thousands_of_patterns_are_routed_at_once():
    import itertools
    import time

    rng = random.Random(1)
    names = [chr(97 + i) for i in range(13)]
    patterns = {p: int(rng.lognormvariate(8, 3)) + 1 for k in range(1, 14) for p in itertools.combinations(names, k)}
    begun = time.perf_counter()
    flow, total = mixture.route(patterns, {s: (rng.random() ** 3, rng.randint(1, 5)) for s in names})
    assert len(patterns) == 8191 and sum(flow.values()) == total == sum(patterns.values())
    assert time.perf_counter() - begun < 10


def test_mix_of_a_table(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=20)) + f" {i}", s) for i, s in enumerate(["Big "] * 600 + ["small"] * 60 + ["other"] * 50)]
    rows += [(10_000 + i, rows[i][1], " SMALL") for i in range(40)] + [(20_000 + i, rows[i][1], "big") for i in range(100)]
    rows += [(30_000, None, "big"), (30_001, "", "big"), (30_002, "x", None), (None, "y", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"key": F.lit(1), "tokens": F.lit("clash")})
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    out, report = mixture.mix(docs, targets, keep_shares=True, documents_per_bucket=40)
    got = {r["source"]: r for r in report.collect()}
    assert got["gone"]["short_tokens"] == got["gone"]["wanted_tokens"] > 0
    assert got["gone"]["tokens"] == 0 and got["big"]["most_copies"] == 1 and got["small"]["most_copies"] == 2
    assert got["small"]["actual_share"] == pytest.approx(4 / 9, abs=0.02) and got["big"]["actual_share"] == pytest.approx(5 / 9, abs=0.02)
    picked = out.collect()
    text = {r[0]: r[1] for r in rows}
    uses = {}
    for r in picked:
        uses[text[r["doc_id"]]] = uses.get(text[r["doc_id"]], 0) + r["copies"]
    assert max(uses[text[i]] for i in range(40) if text[i] in uses) == 1  # shared texts keep the smaller cap
    assert sorted(map(tuple, picked)) == sorted(map(tuple, mixture.mix(docs.repartition(7), targets, keep_shares=True, documents_per_bucket=40)[0].collect()))
    small, _ = mixture.mix(docs, targets, total=200)
    assert sum(r["tokens"] * r["copies"] for r in small.collect()) == pytest.approx(200, abs=40)
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        a, b = mixture.mix(d, t)
        assert a.count() == 0 and b.count() == t.count()


def test_real_shares(spark):
    sf = "/root/testdata/sf0.1"
    report = mixture.mix(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet"), keep_shares=True)[1]
    r = {x["source"]: x for x in report.collect()}
    met = [x for x in r.values() if x["quota_tokens"] > 0]
    whole = sum(x["target_share"] for x in met)
    assert all(abs(x["actual_share"] - x["target_share"] / whole) < 0.01 and x["most_copies"] <= x["max_repeats"] for x in met)
    assert np.isclose(sum(x["actual_share"] for x in r.values()), 1)


def test_the_whole_mix_against_public_token_counts(spark):
    """Tokens, totals, caps and shortages of the registered query, recounted with a public encoder."""
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_ranks(), special_tokens={})
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lower(F.trim("source")).alias("s")).collect()
    out, report = queries.p9_mix(spark, sf).collect(), {r["source"]: r for r in queries.p9_shares(spark, sf).collect()}
    text, source, size = {d["doc_id"]: d["text"] for d in docs}, {d["doc_id"]: d["s"] for d in docs}, {}
    for d in docs:
        if d["text"]:
            size[d["text"]] = len(enc.encode_ordinary(d["text"]))
    one = {d["text"] for d in docs if d["text"] and d["s"] in report}
    total = sum(size[t] for t in one)
    uses, tokens = {}, {}
    for r in out:
        assert source[r["doc_id"]] == r["source"] and r["tokens"] == size[text[r["doc_id"]]]
        uses[text[r["doc_id"]]] = uses.get(text[r["doc_id"]], 0) + r["copies"]
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["copies"] * r["tokens"]
    caps = {}
    for d in docs:
        if d["s"] in report:
            caps[d["text"]] = min(caps.get(d["text"], 99), report[d["s"]]["max_repeats"])
    assert all(n <= caps[t] for t, n in uses.items())
    assert sum(r["quota_tokens"] for r in report.values()) == total
    for s, r in report.items():
        largest = max([size[d["text"]] for d in docs if d["s"] == s and d["text"]], default=0)
        assert r["tokens"] == tokens.get(s, 0) and abs(r["tokens"] - r["quota_tokens"]) <= largest
        assert abs(r["wanted_tokens"] - r["target_share"] * total) <= 1 and r["short_tokens"] == max(r["wanted_tokens"] - r["quota_tokens"], 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    from tests.compare import connect, rows_of_spark, rows_of_sql

    assert rows_of_spark(queries.QUERIES[name](spark, D)) == rows_of_sql(connect(D), queries.ORACLES[name])
