"""Conversation repair, centroid clustering and SentencePiece ids against plain versions."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


# -- conversations


def brute_damage(rows):
    out = {}
    for c, t, role, text in rows:
        here = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        here += [(t, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def brute_repair(rows):
    """One conversation's damaged rows; the programme runs over whole audits from the end."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @cache
    def best(i, state, inserted):
        ways = []
        if i == n and state in ("", "a"):
            ways.append((0, "", ()))
        steps = {"": ["user"], "s": ["user"], "u": ["assistant"], "a": ["user"]}[state]
        if inserted < 2:
            for role in steps:
                c, a, out = best(i, role[0], inserted + 1)
                ways.append((c + 5, "I" + a, (f"{role}:", *out)))
        if i < n:
            _, role, text = rows[i]
            c, a, out = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a, out))
            if kinds[i] not in ("blank", "duplicate"):
                late = 5 * (kinds[i] == "truncated")
                if role[:1] == "s" and state == "" or role[:1] in [x[0] for x in steps]:
                    c, a, out = best(i + 1, role[0], 0)
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *out)))
                for new in steps:
                    c, a, out = best(i + 1, new[0], 0)
                    ways.append((c + 1 + late, "R" + a, (f"{new}:{text}", *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = {r[0] for r in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def made_up(n, seed):
    r, rows = random.Random(seed), []
    texts = ["", " \n", "Yes.", "No", "What?", "So it is! ", "a.b", "é…", None]
    for c in range(n):
        for t in range(r.randint(0, 9)):
            turn = r.choice([t, t, t, t * 3, None, r.randint(-2, 4)])
            rows.append((c, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "Sys", "", None, "umpire"]), r.choice(texts)))
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(7)]
    rows += [(n, t, ["user", "assistant", "assistant"][t % 3], f"Part {t % 50}.") for t in range(120)]
    return rows + [(n + 1, 5, "user", "Same.")] * 40


@pytest.mark.parametrize("piece", [3, 256])
def test_repair_matches_brute_force(spark, piece):
    from shokuba.llm.conversations import repair_conversations

    rows = made_up(150, piece)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, symbols string, n int").repartition(5)
    got = {r["conv_id"]: r.asDict() for r in repair_conversations(df, piece=piece, rounds=3, width=4).collect()}
    want = {c: brute_repair(x) for c, x in brute_damage(rows).items()}
    assert set(got) == set(want)
    for c, x in want.items():
        assert {k: got[c][k] for k in x} == x, (c, [r for r in rows if r[0] == c])


def test_repair_of_the_given_table(spark):
    from shokuba.llm.queries import op11_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in op11_conversation_repair(spark, SF).collect()}
    assert got == {c: {"conv_id": c, **brute_repair(x)} for c, x in brute_damage(rows).items()}


def test_repair_of_empty_tables(spark):
    from shokuba.llm.conversations import repair_conversations

    assert repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_grammar_matrices_are_the_rows_product():
    from shokuba.llm.conversations import compress, product, row_matrix, rule_matrices

    r = random.Random(5)
    rules = ["ua", "ĀĀ", "uU", "āa"]
    known = rule_matrices(rules)
    for _ in range(200):
        s = "".join(r.choices("suaoUAD", k=r.randint(1, 14)))
        plain, packed = None, None
        for x in s:
            plain = product(plain, row_matrix(x)) if plain else row_matrix(x)
        for x in compress(s, rules):
            packed = product(packed, known[x]) if packed else known[x]
        assert {k: (c, str(t)) for k, (c, t) in plain.items()} == {k: (c, str(t)) for k, (c, t) in packed.items()}


# -- centroids


def brute_clusters(kept, k, rounds):
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in kept}
    names = sorted(q, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    cents = [q[i] for i in names[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for v in q.values():
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            cents[n] = [sum(x) // len(vs) for x in zip(*vs)]
    return {i: nearest(v)[::-1] for i, v in q.items()}, cents


VECTORS = "vec_id long, embedding array<float>, label int, q string, near int, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], VECTORS)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clusters_match_brute_force(spark, k):
    from shokuba.llm.centroids import cluster_report

    r = np.random.default_rng(k)
    middles = r.normal(size=(7, 64))
    rows = [(i, (middles[i % 7] + r.normal(size=64) * (0.3 if i % 3 else 0.01)).astype("f4").tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000 + i, [float(i % 2)] * 64) for i in range(20)]
    odd = [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 63 + [float("nan")]), (3004, [float("inf")] + [0.0] * 63), (3005, [None] + [0.0] * 63)]
    got = cluster_report(vectors(spark, rows + odd).repartition(4), k=k).collect()
    want, cents = brute_clusters(rows, k, 5)
    assert {x.vec_id: (x.cluster, x.distance) for x in got} == want and len(got) == len(rows)
    total = sum(d for _, d in want.values())
    for x in got:
        assert x.inertia == total and x.cluster_inertia == sum(d for c, d in want.values() if c == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[x.cluster])).encode()).hexdigest()


def test_clusters_of_empty_repeated_and_null(spark):
    from shokuba.llm.centroids import cluster_report

    assert cluster_report(vectors(spark, [])).count() == 0
    got = cluster_report(vectors(spark, [(None, [0.5] * 64), (1, [0.25] * 64), (1, [0.25] * 64)])).collect()
    assert sorted(x.distance for x in got) == [0, 0, 0] and {x.vec_id for x in got} == {None, 1}
    with pytest.raises(Exception, match="too large"):
        cluster_report(vectors(spark, [(1, [3e38] * 64)])).count()


def test_bounds_never_exceed_distances_and_spare_work():
    from shokuba.llm.centroids import Nearest, choose_pivots, to_pivots

    r = np.random.default_rng(1)
    for scale in (3, 300, 2**21):
        x = np.clip(np.floor(r.normal(size=(400, 64)) * scale + (r.integers(0, 6, 400) * 8 * scale)[:, None]), 1 - 2**27, 2**27 - 1).astype(np.int64)
        x[:40] = x[0]
        x[40:60] = -x[0]
        cents = x[r.choice(400, 30)].tolist()
        pivots = choose_pivots(cents)
        near = Nearest(cents, pivots)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in cents] for v in x[:80].tolist()], object)
        assert (near.lower_bounds(to_pivots(x[:80], pivots)) <= exact).all()
        cluster, distance, needed = near(x, to_pivots(x, pivots))
        whole = np.array([[((v - np.array(c)) ** 2).sum() for c in cents] for v in x])
        assert (cluster == whole.argmin(1)).all() and (distance == whole.min(1)).all()
        assert len(x) <= needed < 0.6 * whole.size


# -- pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def piece_texts(lib):
    r = random.Random(3)
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, lib.get_piece_size())]
    kinds = ["abc", "the in", "aeiou \n", " ▁", "a▁ b\x00", "-=_", "日本語漢字é😀ñ", "01 ", "\t  \n", "()[]{};:. "]
    out = ["", " ", "▁", "\n", "a" * 5000, "bc" * 3000, "".join(r.choices("etaoin", k=9000)), "<0x0A></s><s>"]
    out += [" " * n + x for n in range(1, 70) for x in ("", "the", "\n")]
    out += ["".join(r.choices(pieces, k=r.randint(1, 12))) for _ in range(3000)]
    out += ["".join(r.choices(r.choice(kinds), k=r.randint(0, 60))) for _ in range(2000)]
    return out + ["".join(chr(r.choice([r.randint(1, 127), r.randint(128, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(1000)]


def test_pieces_equal_the_library(library):
    from shokuba.llm.pieces import PieceModel

    path, lib = library
    m, texts = PieceModel(path, units=500), piece_texts(library[1])
    for t, ids in zip(texts, m.encode_many(texts), strict=True):
        want = [*lib.encode(t), 2]
        assert ids.tolist() == want, t
        assert m.decode(ids) == lib.decode(want)


def test_decode_of_any_ids_equals_the_library(library):
    from shokuba.llm.pieces import PieceModel

    path, lib = library
    m, r = PieceModel(path), random.Random(4)
    for _ in range(3000):
        ids = [r.randint(3, 258) if r.random() < 0.6 else r.choice([0, 1, 2, r.randint(259, 31999)]) for _ in range(r.randint(0, 9))]
        assert m.decode(np.array(ids, np.int32)) == lib.decode(ids), ids


def test_piece_query_and_odd_rows(spark, library):
    from shokuba.llm.pieces import decode, encode, piece_digests
    from shokuba.llm.queries import op13_sentencepiece

    path, lib = library
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x" * 300_000), (4, "word " * 100_000), (5, " \t\n "), (5, "日本語 " * 40)]
    df = spark.createDataFrame([(i, t, [1], "z") for i, t in rows], "doc_id long, text string, ids array<int>, decoded string").repartition(3)
    back = decode(encode(df, path), path).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert piece_digests(df.limit(0), path).count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op13_sentencepiece(spark, SF).collect():
        ids = [*lib.encode(texts[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
