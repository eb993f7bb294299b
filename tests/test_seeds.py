"""Seeds, shuffles and draws against another computation of them, and steps that have no SQL."""

import hashlib
import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqscope.functions import columns as C
from seqscope.functions import udfs
from seqscope.operators import protocol, scoring
from seqscope.plans import QUERIES, protocols
from seqscope.sources import datasets, jsonl, store
from seqscope.streaming import monitor

SEED = protocols.SEED
WORD = (1 << 64) - 1
# The published constants of BLAKE2b.
IV = [0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179]
SIGMA = ["0123456789abcdef", "ea489fd61c02b753", "b8c052fdae367194", "7931dcbe265a40f8", "905724afe1bc683d", "2c6a0b834d75fe19", "c51fed4a0763928b", "db7ec13950f4862a", "6fe9b308c2d714a5", "a2847615fb9e3cd0"]


def blake2b(data: bytes, size: int) -> bytes:
    """BLAKE2b without a key, from its description."""
    turn = lambda x, n: (x >> n | x << 64 - n) & WORD
    h = [IV[0] ^ 0x01010000 ^ size, *IV[1:]]
    blocks = [data[i : i + 128] for i in range(0, len(data), 128)] or [b""]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        m = [int.from_bytes(block.ljust(128, b"\0")[8 * i : 8 * i + 8], "little") for i in range(16)]
        v = [*h, *IV]
        v[12] ^= len(data) if last else 128 * (k + 1)
        v[14] ^= WORD if last else 0
        for r in range(12):
            s = [int(c, 16) for c in SIGMA[r % 10]]
            for i, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
                for x, p, q in ((m[s[2 * i]], 32, 24), (m[s[2 * i + 1]], 16, 63)):
                    v[a] = v[a] + v[b] + x & WORD
                    v[d] = turn(v[d] ^ v[a], p)
                    v[c] = v[c] + v[d] & WORD
                    v[b] = turn(v[b] ^ v[c], q)
        h = [x ^ v[i] ^ v[i + 8] for i, x in enumerate(h)]
    return b"".join(x.to_bytes(8, "little") for x in h)[:size]


def seed_of(*parts) -> int:
    return int.from_bytes(blake2b("::".join(map(str, parts)).encode(), 8), "big") % 2**31


def test_blake2b_is_the_published_one():
    assert blake2b(b"abc", 64).hex().startswith("ba80a53f981c4d0d6a2797b69f12f6e94c212f14685ac4b74b12bb6fdbffa2d1")
    for data in (b"", b"x" * 128, b"y" * 300):
        assert blake2b(data, 8) == hashlib.blake2b(data, digest_size=8).digest()


def test_seeds_of_rows(spark, sf_dir):
    assert all(r.seed == seed_of(SEED, "int4", r.doc_id) for r in QUERIES["p05_blake2_seed"](spark, sf_dir).collect())
    own = {r.item_id: r.item_seed for r in protocols.items_of(spark, sf_dir).collect()}
    for r in QUERIES["p15_units_replicated"](spark, sf_dir).collect():
        base = own[r.item_id.split("|replicate:")[0]]
        assert r.item_seed == (base if r.replicate_seed == 0 else seed_of(SEED, base, r.replicate_seed))
    for r in QUERIES["g09_candidate_seeds"](spark, sf_dir).collect():
        assert r.candidate_seed == (r.item_seed if r.candidate == 0 else seed_of(r.item_seed, "candidate", r.candidate))


def shuffled(n: int, seed: int) -> list[int]:
    """The shuffle of the standard generator, by its swaps."""
    draw, out = random.Random(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = draw._randbelow(i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def test_templates_schedules_and_restarts(spark, sf_dir):
    order = shuffled(10, seed_of(SEED, "int4", "budget-profile"))
    assert all(r.template == order[r.c_custkey % 10] for r in QUERIES["b04_assigned_template"](spark, sf_dir).collect())
    found = {}
    for r in QUERIES["b05_random_schedule"](spark, sf_dir).collect():
        found.setdefault(r.id, []).append((r.k, r.trigger_at, r.rollback_tokens))
    rows = {r.id: r for r in protocols.budget.templates(*protocols._orders(spark, sf_dir), ["base_model"]).where("backtrack_count > 0").collect()}
    assert set(found) == set(rows)
    for i, r in rows.items():
        draw = random.Random(seed_of(SEED, i))
        high = max(65, int(r.reference_primary_tokens))
        at = sorted(64 + draw._randbelow(high - 63) for _ in r.rollback_lengths)
        assert sorted(found[i]) == [(k, a, max(1, n)) for k, (a, n) in enumerate(zip(at, r.rollback_lengths, strict=True))]
    customers = [r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()]
    first = sorted(customers, key=lambda c: (seed_of(SEED, "int4", "restart", c - 1), c - 1))[: round(len(customers) * 30 / 200)]
    assert {r.c_custkey for r in QUERIES["b07_restart_subset"](spark, sf_dir).collect()} == set(first)


def test_bootstrap_draws(spark):
    values = [0.5, -1.0, 2.0, 0.25, 3.5, -0.75]
    rows = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "name string, __order int, v double")
    got = protocols.stats.bootstrap(rows, "v", 1200).first()
    draw, means = np.random.default_rng(20260811), []
    for n in (500, 500, 200):
        picks = draw.integers(0, len(values), (n, len(values)))
        means += [sum(values[i] for i in own) / len(values) for own in picks]
    means.sort()
    at = lambda q: means[int(q * 1199)] + (q * 1199 - int(q * 1199)) * (means[int(q * 1199) + 1] - means[int(q * 1199)])
    assert (got.low, got.high) == pytest.approx((at(0.025), at(0.975)))


def test_normal_form_of_compatibility_characters(spark):
    texts = ["ﬁne　ｔext ① x", "é é", " \t", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(udfs.normalize("t").alias("n")).collect()
    assert [r.n for r in got] == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts]


def test_generation_accounts(spark, sf_dir):
    """Each run's accounts are those of a run that is driven here, event by event."""
    for r in QUERIES["g01_generation_accounts"](spark, sf_dir).limit(20).collect():
        m = monitor.Monitor(protocols.STREAM, monitor.Calibrator(protocols.POOLS))
        source, sampled, alarms = monitor.looping_source(), 0, 0
        while sampled < 120 and (token := source(r.run_id, m.tokens, m.overrides, m.rerolls)):
            alarms += sum(e["type"] == "alarm" for e in m.push(token))
            sampled += 1
        assert (r.sampled, r.alarms, r.emitted, r.rerolls, r.deleted) == (sampled, alarms, len(m.tokens), m.rerolls, sampled - len(m.tokens))


def test_mcnemar_of_many_pairs(spark):
    from fractions import Fraction

    for c, r in ((600, 600), (550, 650), (49_700, 50_300), (2000, 0), (0, 3)):
        n, term, total = c + r, 1, 1
        for i in range(1, min(c, r) + 1):
            term = term * (n - i + 1) // i
            total += term
        want = float(min(Fraction(1), Fraction(2 * total, 2**n)))
        assert spark.range(1).select(C.mcnemar(F.lit(c), F.lit(r)).alias("p")).first().p == pytest.approx(want, rel=1e-8)


def test_softmax_of_long_logits(spark):
    x = np.sin(np.arange(5000.0))
    row = spark.createDataFrame([(x.tolist(), [3, 1, 3, 4999, 7000, -2])], "l array<double>, seen array<int>")
    w = np.exp(x - x.max())
    p = w / w.sum()
    got = row.select(C.entropy(F.col("l")).alias("h"), C.chosen_logprob(F.col("l"), F.lit(17)).alias("lp"), C.repetition_penalty(F.col("l"), F.col("seen"), 2.0).alias("q"), C.sampled(F.col("l"), F.lit(0.5)).alias("t")).first()
    assert (got.h, got.lp) == pytest.approx((-(p * np.log(p)).sum(), np.log(p[17])))
    want = x.copy()
    for i in (1, 3, 4999):
        want[i] = x[i] * 2 if x[i] < 0 else x[i] / 2
    assert got.q == want.tolist()
    assert got.t == int(np.searchsorted(np.cumsum(p), 0.5, "right"))


@pytest.mark.parametrize(("text", "want"), [(r"\frac{\sqrt2}{3}", r"\sqrt2/3"), (r"\left( \frac 1 2 \right)", r"(\frac12)"), (r"\sqrt{x^{2}}", "sqrt(x^2)"), (r"\dfrac{a{b}}{c{d}}", "ab/cd"), ("x − 3\\cdot 2", "x-3*2"), (r"\text{ 5 cm}", "5cm"), (r"a}{b", "a}{b"), (r"90^{\circ}.", "90"), ("-0", "0"), ("+1.500", "1.5"), (r"\boxed{\text{A}}", "a")])
def test_latex(text, want):
    assert udfs.normalize_math_text(text) == want


def test_scores_by_data_set(spark):
    rows = [("math500", r"so \boxed{\frac{1}{2}}", r"\dfrac{1}{2}"), ("gsm8k", "#### 1,000", "#### 1000"), ("jsonl", "it is 7", "7"), ("jsonl", "it is 7", None), (None, "x", None), ("gsm8k", "none", None)]
    out = scoring.score(spark.createDataFrame(rows, "dataset string, text string, reference string")).collect()
    assert [(r.correct, r.answer_extraction_ok, r.reference_extraction_ok) for r in out] == [(1.0, True, True)] * 3 + [(None, None, None)] * 2 + [(0.0, False, False)]


def test_items_and_configurations(spark):
    rows = spark.createDataFrame([(i, f"q{i}", f"#### {i}", None if i % 2 else f"own{i}") for i in range(12)], "k long, question string, answer string, uid string")
    assert datasets.items(rows, "gsm8k", "test", "k", -3).count() == 0
    assert datasets.items(rows, "gsm8k", "test", "k", 99).count() == 12
    assert [r.id for r in datasets.items(rows, "gsm8k", "test", "k", 3, id="uid").orderBy("question").collect()] == ["own0", "gsm8k-test-000001", "own2"]
    a, b = ([r.question for r in datasets.items(rows, "math500", "test", "k", 5, seed=s).collect()] for s in (1, 2))
    assert a != b and a == [r.question for r in datasets.items(rows, "math500", "test", "k", 5, seed=1).collect()]
    with pytest.raises(ValueError, match="no config"):
        datasets.union_of({}, "k")


def test_lines_prompts_and_traces(spark, tmp_path):
    path = str(tmp_path / "p.jsonl")
    rows = [{"prompt": "", "question": "q0"}, {"prompt": "p1", "id": "x"}, {"input": ""}, {"input": "i2"}, {"prompt": "p3"}]
    (tmp_path / "p.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    assert [tuple(r) for r in jsonl.prompts(spark, path, 3).collect()] == [("0", "q0", None), ("x", "p1", None), ("2", "i2", None)]
    (tmp_path / "t.jsonl").write_text('\n{"tokens":[{"token_id":1,"logits":[0.0,1.0]}]}\n{"tokens":[{"token_id":1,"logits":[0.0,1.0]}]}\n')
    assert sorted(r.run_id for r in jsonl.traces(spark, str(tmp_path / "t.jsonl")).collect()) == ["1", "2"]
    (tmp_path / "bad.jsonl").write_text('{"tokens":[{"token_id":1}]}\n')
    with pytest.raises(Exception, match="without logits"):
        jsonl.traces(spark, str(tmp_path / "bad.jsonl")).collect()


def test_saved_pools_are_checked(spark, tmp_path):
    pools = spark.createDataFrame([("0-512", 0.5), ("0-512", 0.25), ("512-1024", 1.0)], "bucket string, score double")
    store.save_pools(pools, str(tmp_path / "c"), 1e-4)
    again, clip = store.load_pools(spark, str(tmp_path / "c"))
    assert (again.count(), clip) == (3, 1e-4)
    pools.limit(1).write.mode("append").parquet(str(tmp_path / "c/pools"))
    with pytest.raises(ValueError, match="pools"):
        store.load_pools(spark, str(tmp_path / "c"))


def test_digests_and_duplicates(spark):
    ids = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "id string")
    assert tuple(protocol.ids_digest(ids, "id").first()) == (2, hashlib.sha256(b"a\nb\n").hexdigest())
    with pytest.raises(ValueError, match="too many"):
        protocol.ids_digest(ids, "id", 1)
    assert protocol.ids_digests(ids.limit(0), "id").first().ids == 0
    with pytest.raises(Exception, match="duplicate unit a"):
        protocol.first_mismatches(ids.withColumn("v", F.length("id")).where("id = 'a'"), ids.withColumn("v", F.ascii("id")), "id", "v").collect()


def test_files_have_their_hashes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    assert {r.sha256 for r in store.file_hashes(spark, str(tmp_path)).collect()} == {hashlib.sha256(b"abc").hexdigest()}


def test_plain_loop():
    tokens, why = monitor.plain_run("r", monitor.looping_source(length=30), 100)
    assert (len(tokens), why) == (30, "eos")
    assert monitor.plain_run("r", monitor.looping_source(length=30), 10)[1] == "max_new_tokens"
    warm = monitor.plain_run("r", monitor.looping_source(loop_from=0, length=30), 100, temperature=0.6)[0]
    assert warm != monitor.plain_run("r", monitor.looping_source(loop_from=0, length=30), 100)[0]
