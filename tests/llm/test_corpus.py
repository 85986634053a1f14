"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, fingerprints, licenses, mixing, near_copies, neighbours, repeats, secret_scan, sharding, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, sig string, score double"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def rows(texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    return [(i, t, "en", (sources or ["a", "b", None])[k % 3], None if t is None else len(t), "x", "y", 0.5) for k, (i, t) in enumerate(zip(ids, texts))]


def frame(spark, texts, ids=None, sources=None):
    return spark.createDataFrame(rows(texts, ids, sources), SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Thing", "erand", "ing", "ouer", "tion", "ré", "héan"]) + rng.choice(["", "er", "st", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [prose(rng, n) for n in (3, 20, 80, 200, 400, 900)]
    near = made[3].replace("ing", "ung", 2)
    return [*made, None, "", "   ", near, made[4], made[4][50:700] + " tail " + made[3][:300], "ab " * 300, "x" * 5000, "one", "two words",
            'db_password = "hunter2secret"', "no secret here", "KEY = 'f00dCAFE99xyzQ'\nclient_secret = KEY", "AKIA" + "Q" * 20, "0123456789abcdef" * 3]


def test_bpe_equals_library_and_restores_text(spark, texts):
    library = Tokenizer.from_file(TOKENS)
    odd = ["<|endoftext|>Mixed <|startoftext|>", "É İΣΑΣ ½²٣ \x1c\x85 漢字🙂", "it's we'll 'S x" + "ab" * 400, "é combining"]
    given = [*texts, *odd]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, given), TOKENS).collect()}
    for i, t in enumerate(given):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), want)
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.token_ids(frame(spark, ["Hello  wörld, 12"]), TOKENS).first()
    assert back.restored == "hello wörld , 1 2 "


def test_simhash_components(spark, texts):
    def slow(t):
        words = (t or "").encode().lower().split()
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    found = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [found[i].fp % 2**64 for i in range(len(texts))] == [slow(t) for t in texts]
    assert found[10].component_id == 4 and found[7].component_id == found[8].component_id == 6
    kept = simhash.first_of_each(frame(spark, [*texts, texts[0]], [*range(len(texts)), 0]))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert kept.filter("doc_id = 0").count() == 1 and kept.filter("doc_id = 10").count() == 0


@pytest.mark.parametrize("hot", [256, 3])
def test_links_are_all_found_also_in_large_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    pairs = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()
    assert {(min(r), max(r)) for r in pairs} == want
    labels = {r.node: r.label for r in simhash.components(spark.createDataFrame(list(want), "a bigint, b bigint")).collect()}
    assert all(labels[a] == labels[b] for a, b in want) and all(labels[labels[a]] == labels[a] <= a for a in labels)


def test_near_copies_stage_equals_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))] for _ in range(12)]
    made = [" ".join(w) for w in base]
    for w in base:
        for edits in (1, 2, 3, 4, 6, 8):  # copies with changed words, similarity about 0.6 to 0.97
            copy = list(w)
            for at in rng.sample(range(len(w)), edits):
                copy[at] = f"x{rng.randrange(10**9)}"
            made.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(30))
    made += [f"{passage} " + " ".join(f"q{k}_{i}" for i in range(20)) for k in range(40)]  # a common passage
    made += [None, "", " ", "four words stand here", "Four words  stand here", "four words stand there"]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets, top = [shingles(t) for t in made], list(range(len(made)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    band = 0
    for a in range(len(made)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            band += 0.8 <= j < 0.95
            if j >= 0.8:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    assert band > 20
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, frame(spark, made), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(made)) if root(i) == i]
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, made)).collect()}
    assert found == {i: root(i) for i in range(len(made))}


def test_near_copies_begin_with_verified_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(8)]
    made = [" ".join(w) for w in base] + [" ".join([*w[:-1], "other"]) for w in base]
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *more: asked.append({r.fp for r in fps.collect()}) or links(fps, *more))
    found = near_copies.near_copies(frame(spark, made)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 8 for i in range(16)}
    sets = [near_copies.shingle_set(t.encode()) for t in made]
    bits = [near_copies.fingerprint(s) for s in sets]
    assert asked == [set(bits)]
    for s, f in zip(sets, bits):
        whole = [int(x) % 2**64 for x in s]
        assert f % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in whole) > len(whole))
    fp = {r.doc_id: r.fp for r in found}
    nodes = spark.createDataFrame([(fp[i], bits[i]) for i in range(16)], "fp bigint, sim bigint")
    pairs = {(max(r), min(r)) for r in near_copies.fingerprint_pairs(nodes, []).collect()}
    near = {(max(fp[i], fp[j]), min(fp[i], fp[j])) for i in range(16) for j in range(i) if ((bits[i] ^ bits[j]) % 2**64).bit_count() <= 2}
    assert pairs == near and near


def test_parities_bound_the_difference_and_spare_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 30, 3000):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for _ in range(2))
        b = np.union1d(a[: n // 2], b)
        differ = sum(int(x).bit_count() for x in (near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b)) and not (near_copies.parities(a) ^ near_copies.parities(a)).any()
    draw, compared, verified = random.Random(5), [], near_copies._verified
    words = [f"p{i}" for i in range(100)]
    made = [" ".join(f"x{k}_{i}" if i in changed else w for i, w in enumerate(words)) for k in range(40) for changed in [set(draw.sample(range(100), 4))]]  # about 0.5 alike
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: compared.append(pairs.select("a", "b").distinct().count()) or verified(pairs, *more))
    assert near_copies.near_copies(frame(spark, made)).select("component_id").distinct().count() > 30
    assert compared[-1] < 20  # of 780 pairs


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    given = [prose(rng, rng.randint(1, 60)) for _ in range(300)] + [None, "", "   "]
    sized = frame(spark, given).select("doc_id", F.array("source").alias("members"), mixing.words("text").alias("size"), "lang")
    got = mixing.mix(sized, "members", "size").collect()
    assert len(got) == 303 and all(r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    goal = {tuple(r.members): r.target for r in got}
    assert math.isclose(sum(goal.values()), 1.5 * total)
    for members, target in goal.items():
        assert abs(sum(r.taken for r in got if tuple(r.members) == members) - target) <= 3
    assert sorted(got) == sorted(mixing.mix(sized, "members", "size").collect())
    assert mixing.mix(sized.limit(0), "members", "size").count() == 0


def test_flow_routes_overlapping_sources():
    sent = mixing.flow([100, 50, 40], [[0], [0, 1], [1]], [120, 90], 2)
    assert [sum(s.get(k, 0) for s in sent) for k in (0, 1)] == [120, 90]
    assert [sum(s.values()) for s in sent] == [120, 50, 40]  # repeats only what one pass cannot fill
    assert mixing.targets([10, 100], [1, 1], 1.5) == [20.0, 145.0]


def test_secrets(spark, texts):
    got = {r.doc_id: r for r in secret_scan.scan(frame(spark, texts)).collect()}
    at = texts.index("KEY = 'f00dCAFE99xyzQ'\nclient_secret = KEY")
    assert got[at].spans == "literal:7:21"  # the constant reaches a sensitive name
    assert got[at - 2].spans.startswith("assign:3:28") and (got[at - 1].n_assign, got[at - 1].spans) == (0, "")
    assert got[at + 1].spans == "access:0:24" and got[at + 2].spans == "hex:0:48" and got[6].spans == ""
    clean = {r.doc_id: r for r in secret_scan.redact(frame(spark, texts), length="n_chars").collect()}
    assert clean[at].text == "KEY = '[secret]'\nclient_secret = KEY" and clean[at].n_chars == len(clean[at].text)
    assert clean[6].text is None and clean[3].text == texts[3] and clean[3].sig == "y"


def test_secrets_in_long_texts():
    many = "".join([f"password=abcdef{i} " for i in range(20_000)])
    for text in ("a" * 300_000, "a." * 200_000 + " = 'x'", many, "token: '" * 50_000, " " * 300_000):
        base = secret_scan.base_spans(text)
        assert set(base) <= set(secret_scan.all_spans(text, base))
    assert len(secret_scan.base_spans(many)) == 20_000
    text = 'apiToken = "Zx81kQpL77aa" \npassword="Zx81kQpL77aa"'
    assert secret_scan.written(secret_scan.all_spans(text, secret_scan.base_spans(text))) == "assign:3:24,assign:27:49"
    text = "my.access-key := 'Zx81kQpL77aa'"
    assert secret_scan.written(secret_scan.all_spans(text, [])) == "literal:18:30"


def test_licenses(spark):
    given = ["Released under the MIT License.", "x MIT license, mit-License y\nApache é License", "the mit of license", None, "", "This work is licensed under the GNU General Public License, version 3.",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that following conditions are met: x", "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, given)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (5, 1, 3, "mit", 1.0)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (2, 1, 3, 9)
    assert [got[i].labels for i in (2, 3, 4, 5, 6, 7)] == ["", "", "", "gpl,gpl-3.0", "bsd", "cc-by-nc-4.0"]
    assert got[4].n_words == 0 and got[4].first_word is None and got[6].base_labels == "" and 0.9 <= got[6].score < 1
    assert licenses.scan(frame(spark, [])).count() == 0


def test_wrapped_licenses_equal_brute_force_over_all_windows(spark):
    rng = random.Random(4)
    given = []
    for _, template in licenses.TEMPLATES:
        parts = template.split(" ")
        for width in (4, 9):
            lines = [" ".join(parts[i : i + width]) for i in range(0, len(parts), width)]
            given.append(prose(rng, rng.randint(0, 90)) + "\n# " + "\n# ".join(lines) + ".\n" + prose(rng, 40))
        mixed_in = [p for x in parts for p in ([x, "zz"] if rng.random() < 0.45 else [x])]  # near the width of a window
        given.append(prose(rng, 31) + "\n" + "\n".join(mixed_in))
        given.append(" ".join(f"{x} " + "zz " * 60 for x in parts))  # scattered over one long line
    given.append(" ".join(rng.choice(" ".join(t for _, t in licenses.TEMPLATES).split()) for _ in range(3000)))

    def slow(t):
        w, found, best = [x for x in re.split("[^a-z0-9\x80-\U0010ffff]+", t.lower()) if x], set(), 0.0
        for label, template in licenses.TEMPLATES:
            parts = template.split(" ")
            n, tokens = math.ceil(licenses.SPREAD * len(parts)), set(parts)
            most = max(len(tokens & set(w[i : i + n])) for i in range(len(w)))
            if most >= licenses.THRESHOLD * len(tokens) - 1e-9:
                found.add(label)
                best = max(best, most / len(tokens))
        return found, best

    got = {r.doc_id: r for r in licenses.scan(frame(spark, given)).collect()}
    for i, t in enumerate(given):
        found, best = slow(t)
        assert set(filter(None, got[i].labels.split(","))) == found | set(filter(None, got[i].base_labels.split(",")))
        assert math.isclose(got[i].score, 1.0 if got[i].n_base else best)
    assert all(got[4 * k + j].score == 1.0 and label in got[4 * k + j].labels for k, (label, _) in enumerate(licenses.TEMPLATES) for j in (0, 1))
    assert all(got[4 * k + 3].labels == "" for k in range(len(licenses.TEMPLATES)))


def test_shards(spark):
    rng = random.Random(3)
    keys = [str(rng.randint(0, 60)) for _ in range(400)] + ["big"] * 300 + [None] * 5
    data = [(i, k, rng.randint(0, 50), "z") for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "doc_id bigint, k string, size bigint, shard_note string")
    got = sharding.minimax(df, 7, "size", F.col("k"), ["doc_id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(got) == len(data) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    assert max(len({r.shard for r in got if r.k == k}) for k in set(keys)) == 1
    # the same order, cut by trying every capacity
    sums = {}
    for _, k, n, _ in data:
        g = "" if k is None else hashlib.sha256(k.encode()).hexdigest()
        sums[g] = sums.get(g, 0) + n
    large = sums.pop(hashlib.sha256(b"big").hexdigest())
    sizes = [sums[g] for g in sorted(sums)]

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > c else (n, at + s)
        return n <= 6

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    totals = sorted(sum(r.size for r in v) for v in by.values())
    assert totals[-1] == large and totals[-2] == best
    assert sharding.minimax(df.limit(0), 7, "size", F.col("k"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("together", [20_000, 2])
def test_repeats_equal_brute_force(spark, texts, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)  # groups above it are split
    rng = random.Random(9)
    given = [*texts, texts[5][100:900] + prose(rng, 30) + texts[5][500:1500], prose(rng, 50) + texts[4], *[prose(rng, 9) + texts[5][300 + i % 3 : 420 + i] + prose(rng, 9) for i in range(8)]]
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, given)).collect()}
    seen = set()
    for i, t in enumerate(given):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i
    twice = repeats.remove_repeats(frame(spark, [texts[5], texts[5], None], [None, None, 4])).collect()
    assert len(twice) == 3 and {r.n_removed for r in twice if r.doc_id is None} == {0}


def test_repeats_tell_texts_of_one_id_apart(spark):
    """Two texts of one id whose hashes share 24 bits: one repeats an earlier text, the other nothing."""
    rng = random.Random(12)
    passage, other = prose(rng, 60), prose(rng, 60)
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFF
    seen = {low(f"{passage} {i}"): f"{passage} {i}" for i in range(20_000)}
    clean = next(t for t in (f"{other} {j}" for j in range(60_000)) if low(t) in seen)
    rows = repeats.remove_repeats(frame(spark, [passage, seen[low(clean)], clean], [0, 7, 7])).collect()
    assert sorted((r.doc_id, r.n_removed > 0, r.n_bytes) for r in rows if r.doc_id == 7) == sorted([(7, True, len(seen[low(clean)].encode())), (7, False, len(clean.encode()))])
    empty = repeats.remove_repeats(frame(spark, ["x"]).limit(0))
    assert empty.count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[300:330] = x[0]
    data = [(i, [float(v) for v in r], "p") for i, r in enumerate(x)] + [(700, None, "p"), (720, [0.0] * 16, "p"), (740, [float("nan")] * 16, "p"), (760, [1.0], "p")]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, part string")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, parts=8, probes=8).collect()
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    for i in range(0, 600, 20):
        want = sorted(range(600), key=lambda j: (-round(exact[i, j], 9), j))[:20]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want and all(abs(r.score - exact[i, r.vec_id]) < 1e-9 for r in mine)
    assert len(got) == 600
    some = neighbours.search(df, F.col("vec_id") % 20 == 0, parts=8, probes=6).collect()
    pairs = {(r.query_id, r.vec_id) for r in got}
    assert len(pairs & {(r.query_id, r.vec_id) for r in some}) >= 0.85 * len(pairs)
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rng, 60).split()
        if bad:
            for w in rng.sample(["vile", "scum", "trash"], 2):
                words.insert(rng.randrange(len(words)), w)
        data.append(" ".join(words))
        labels.append((i, int(bad)))
    df, known = frame(spark, [*data, None, ""]), spark.createDataFrame([*labels, (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(df, known)
    got = {r.doc_id: r for r in toxicity.score(df, model, ["doc_id"]).collect()}
    held = [i for i, _ in labels if int.from_bytes(__import__("zlib").crc32(str(i).encode()).to_bytes(4, "big"), "big") % 4 == 2]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert got[400].score == got[401].score and got[401].predicted == 0
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in got.values())
    assert toxicity.passages(df, model).filter("doc_id = 0").count() >= 1
    blank = toxicity.train(df, known.limit(0))
    assert {r.predicted for r in toxicity.score(df, blank, ["doc_id"]).collect()} == {0}


def test_maximal_segments_equal_search_over_all_cuts():
    rng = random.Random(8)
    for _ in range(200):
        scores = [rng.choice([-1.0, -2.0, 1.0, 2.0, 3.0]) for _ in range(12)]
        found = toxicity.maximal_segments(enumerate(scores), 0.0)
        best = max([sum(scores[a:b]) for a in range(12) for b in range(a + 1, 13)])
        assert max([s for s, _, _ in found], default=best) == best or best <= 0
        assert all(math.isclose(s, sum(scores[a:b])) for s, a, b in found)


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in fingerprints.compare_edited(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        h = len(t) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[4].fingerprint == got[10].fingerprint and got[6].fingerprint == got[8].fingerprint == ""
    one = fingerprints.compare_edited(frame(spark, ["a b c d e f"])).first()
    assert one.near_next == 1.0
    assert fingerprints.compare_edited(frame(spark, [])).count() == 0
    pair = spark.createDataFrame([(texts[5], texts[5] + " " + texts[4])], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    inside, shingles = pair.select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_shingles(F.col("a"))).first()
    words = texts[5].lower().split()
    true = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert inside > 0.8 and abs(shingles / true - 1) < 0.3


def test_pipeline_keeps_clean_rows_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.hold(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns and docs.count() > n / 2, name
    final = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert final.count() == docs.count()
