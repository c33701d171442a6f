"""The prefix trie, the Merkle manifest and the toxicity grammar against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopfloor.llm import merkle_manifest, prefix_trie, toxicity
from tests.llm.conftest import SF

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rule():
    return F.crc32(F.col("conv_id").cast("string")) % 4, F.col("conv_id") - F.col("conv_id") % 20


def turn_key(r):
    role, text = (r["role"] or "").encode(), (r["text"] or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()


def plain_trie(rows, borrow=True):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            own[r["conv_id"]].append(r)
    for v in own.values():
        v.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, turn_key(r)))
    own = {k: [(r["role"] or "", r["text"] or "") for r in v] for k, v in own.items()}
    built = {}
    for k, v in own.items():
        head = zlib.crc32(str(k).encode()) % 4 if borrow else 0
        built[k] = tuple(own.get(k - int(math.fmod(k, 20)), [])[:head]) + tuple(v[head:])
    members = defaultdict(list)
    for k, v in built.items():
        for i in range(len(v) + 1):
            members[v[:i]].append(k)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        tokens = (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for i in range(len(p) + 1):
            saved[p[:i]] += tokens
            leaves[p[:i]] += not children[p]
    return sorted(repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(x) for x in sorted(m) if len(built[x]) == len(p)).encode()).hexdigest())) for p, m in members.items())


def trie_rows(turns, **options):
    return sorted(repr(tuple(r)) for r in prefix_trie.trie(turns, **options).select(TRIE).collect())


def test_trie_of_the_given_conversations(session):
    turns = session.read.parquet(f"{SF}/conversations.parquet")
    assert trie_rows(prefix_trie.paths(turns, *rule())) == plain_trie(turns.collect())


@pytest.fixture(scope="module")
def hard_turns(session):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, -41, -40, -1, 0, 20, 21, 22, 39, 40, 45]), rnd.choice([None, 0, 1, 1, 2]), rnd.choice([None, "", "user"]), rnd.choice([None, "", "a b", "a  b\tc", "x"])) for _ in range(120)]
    rows += [(60, i, "user", "same") for i in range(300)] + [(61, i, "user", "same") for i in range(300)] + [(65, None, "user", "same")] * 200
    rows += [(1000 + i, 0, "user", "hello there") for i in range(500)] + [(70, 0, "user", "long " * 50_000), (-(2**62), 0, "u", "far")]
    kind = "conv_id long, turn long, role string, text string"
    clash = ("piece", "local", "depth", "a", "b", "owner", "head", "length", "_salt", "n")
    return session.createDataFrame(rows, kind).withColumns({c: F.lit("x") for c in clash}).repartition(7)


@pytest.mark.parametrize("borrow", [True, False])
def test_trie_of_hard_rows(hard_turns, borrow):
    turns = prefix_trie.paths(hard_turns, *rule()) if borrow else prefix_trie.paths(hard_turns)
    assert trie_rows(turns) == plain_trie(hard_turns.collect(), borrow)


def test_trie_is_the_same_when_the_sketch_tells_nothing_apart(hard_turns):
    assert trie_rows(prefix_trie.paths(hard_turns, *rule()), cells=2) == plain_trie(hard_turns.collect())


@pytest.mark.parametrize("cells", [prefix_trie.CELLS, 1 << 11])
def test_trie_keeps_nodes_that_clash_in_the_sketch_below_a_tail(session, cells):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["u", "a"]), f"w{rnd.randrange(10**6)} x") for c in range(800) for t in range(rnd.randrange(1, 12))]
    turns = session.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert trie_rows(prefix_trie.paths(turns, *rule()), cells=cells) == plain_trie(turns.collect())


def test_trie_of_no_rows(hard_turns):
    assert trie_rows(prefix_trie.paths(hard_turns.limit(0), *rule())) == []
    assert trie_rows(prefix_trie.paths(hard_turns.where("conv_id IS NULL"))) == []


def test_sketch_never_counts_too_little(session):
    rng = np.random.default_rng(2)
    values = rng.integers(-(2**63), 2**63, (400, 2))
    rows = session.createDataFrame([(int(a), int(b)) for a, b in [*values, *values[:100]]], "a long, b long").repartition(5)
    counts = prefix_trie.sketch(rows, 8)
    at = prefix_trie._cells(*(values.T.astype(np.int64).view(np.uint64)), 8) if values.flags.c_contiguous else None
    estimate = np.min([counts.reshape(prefix_trie.SKETCH_ROWS, -1)[k][at[k]] for k in range(prefix_trie.SKETCH_ROWS)], axis=0)
    assert (estimate >= 1).all() and (estimate[:100] == 2).all()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    by = defaultdict(list)
    for r in rows:
        text = r["text"]
        if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        leaf, other = (H(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))) for t in (r["text"], text))
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, other))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(v)]) for s, v in by.items()}
    top, out = climb([trees[s][-1][0] for s in names]), []
    for at, s in enumerate(names):
        for i, (known, n, leaf, other) in enumerate(sorted(by[s])):
            now, proof = other, []
            for tree, j in ((trees[s], i), (top, at)):
                for level in tree[:-1]:
                    low = j // 16 * 16
                    run = level[low:low + 16]
                    proof += run[:j - low] + run[j - low + 1:]
                    now, j = H(*run[:j - low], now, *run[j - low + 1:]), j // 16
            out.append((n if known else None, leaf, trees[s][-1][0], top[-1][0], H(*proof), now, now == top[-1][0]))
    return sorted(map(repr, out))


def manifest_rows(docs):
    return sorted(repr(tuple(r)) for r in merkle_manifest.audit(docs, merkle_manifest.lower_case_some()).collect())


@pytest.mark.parametrize("name", ["documents", "hard", "empty"])
def test_manifest(name, request):
    docs = request.getfixturevalue(name)
    assert manifest_rows(docs) == plain_manifest(docs.collect())


def test_manifest_over_several_blocks_and_many_sources(session):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, rnd.randrange(99_999), 7]), "".join(rnd.choice("Abé") for _ in range(3)), "en", rnd.choice([None, 1]), rnd.choice([None, "big", "big", "big", f"s{rnd.randrange(40)}"])) for _ in range(9_000)]
    docs = session.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string")
    docs = docs.withColumns({c: F.lit(0) for c in ("grp", "block", "place", "many", "piece", "digest", "id")})
    assert manifest_rows(docs) == plain_manifest(docs.collect())
    assert manifest_rows(docs.limit(1)) == plain_manifest(docs.limit(1).collect())


def test_a_kept_state_goes_on_like_the_whole_hash():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 2**32, (37, 8)).astype(np.uint32)
    texts = [x.astype(">u4").tobytes().hex() for x in digests]
    run = np.arange(37) // 16
    before, top = merkle_manifest.midstates(merkle_manifest.as_blocks(digests), run)
    assert [x.hex() for x in merkle_manifest._binary(top)] == [H(*texts[i:i + 16]) for i in (0, 16, 32)]
    state = before[[20]]
    for i in range(20, 32):
        state = merkle_manifest.absorb(state, merkle_manifest.as_blocks(digests[[i]]))
    assert (merkle_manifest.finish(state, np.array([16])) == top[[1]]).all()


def test_toxic_documents_are_told_apart_on_the_held_out_fold(session):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (session.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    held = [(out[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    toxic, other = ([s for s, t in held if t == k] for k in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in other)
    assert wins / len(toxic) / len(other) > 0.8
    assert sum(s >= 0.5 for s in other) <= 0.02 * len(other)


def made_labels(session, rows):
    return session.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, None, None), (None, 1, 1)], [(i, 1, i % 2) for i in range(1, 11)] + [(1, 0, 1)]])
def test_toxicity_of_hard_rows(session, hard, empty, labels):
    table = made_labels(session, labels)
    out = toxicity.toxicity(hard, table).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in hard.collect())
    assert all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.toxicity(empty, table).collect() == []


def test_labels_of_the_held_out_fold_change_nothing(session, documents):
    labels = session.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(documents, labels).collect()) == sorted(toxicity.toxicity(documents, other).collect())


def test_terms_are_counted_by_text(session):
    rnd = random.Random(1)
    rows = [(f"{'zorg' if i % 3 == 0 else 'plain'} {rnd.choice(['aa', 'bb'])} {rnd.randrange(40)}x{chr(97 + i % 26)}", int(i % 3 == 0)) for i in range(400)]
    got = {r["term"]: (r["toxic"], r["other"]) for r in toxicity.learned_terms(session.createDataFrame([(i, *r) for i, r in enumerate(rows * 2)], "doc_id long, text string, toxic int")).collect()}
    best = {}
    for text, toxic in rows:
        best[text] = max(best.get(text, 0), toxic)
    want = {0: Counter(), 1: Counter()}
    for text, toxic in best.items():
        want[toxic].update({t for w in toxicity.words_of(text) for t in toxicity.terms_of(w)})
    n = Counter(best.values())
    weight = {t: math.log((want[1][t] + 0.5) / (n[1] + 1)) - math.log((want[0][t] + 0.5) / (n[0] + 1)) for t in want[1]}
    assert got == {t: (want[1][t], want[0][t]) for t in weight if want[1][t] >= toxicity.LEAST_TEXTS and weight[t] >= toxicity.LEAST_WEIGHT}
    assert "zorg" in got and "^zorg" in got and "plain" not in got


@pytest.mark.parametrize(("text", "kinds"), [
    ("a zorg here", [0]), ("you are a zorg", [2]), ("not a zorg", [4]), ("he said a zorg came", [10]), ("\"zorg\" zorg", [8, 0]), ("not. zorg", [0]),
    ("you kill zorg", [3, 2]), ("no a b c zorg", [0]), ("said. zorg", [0]), ("“a. zorg", [8]), ("nothing", [])])
def test_scopes_of_the_grammar(text, kinds):
    lexicon = toxicity.Lexicon({"zorg": 3.0})
    assert [k for _, _, m in toxicity.clauses(text, lexicon) for k, _ in m] == kinds


def test_the_fit_is_that_of_the_whole_table(session):
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(500, toxicity.KINDS + 1)))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=500) > 0).astype(int)
    rows = session.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "features array<double>, toxic int").repartition(6)
    model = toxicity.fitted(rows)
    full = np.column_stack([x, np.ones(500)])
    ridge = np.r_[np.full(toxicity.KINDS + 1, toxicity.RIDGE), 1e-6]
    slope = full.T @ (y - 1 / (1 + np.exp(-full @ model))) - ridge * model
    assert np.abs(slope).max() < 1e-4
