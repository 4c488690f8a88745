"""Text operators against plain versions, and on nulls, empty and long texts, ties, repeats, empty and wider tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, run int, fp long, v string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, "y") for i, t in rows], DOCS)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, words(3)), (6, words(3)), (6, words(3)), (7, words(20_000, 1)), (8, "日本語 " * 40), (9, "é\x00\x01\x02\x03"), (None, words(60, 2)), (None, None)]


# -- exact dedup


def test_exact_dedup_groups(spark):
    from shokuba.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    df = docs(spark, ODD).repartition(5)
    got = exact_duplicates(df.coalesce(1), runs=4, fan_in=2).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
    for sha, ids in by_sha.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert exact_duplicates(docs(spark, [])).count() == 0
    path = "/tmp/spark-exact-" + words(1, random.randrange(10**9))
    df.coalesce(2).write.parquet(path)
    kept = drop_exact_duplicates(spark.read.parquet(path))
    assert kept.count() == len(by_sha) and kept.columns == df.columns


# -- simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_brute_force():
    from shokuba.llm.simhash import simhash

    for t in ["", "a", "a b c", "a b c d", "A b C d e", "x " * 50, words(700), "É é\x0bb\xa0c d e f"]:
        assert simhash(t) % 2**64 == brute_fingerprint(t)


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_masks_cover_every_pair(n):
    from shokuba.llm.simhash import block_masks

    masks = block_masks(n, 4)
    r = random.Random(n)
    for _ in range(300):
        diff = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not diff & (m % 2**64) for m in masks)


def test_html_keeps_what_follows_open_anchors_and_short_lines():
    from shokuba.llm.html_text import main_text

    body = "A paragraph of the article that is long enough to be text."
    for anchor in ("<a name=top>", "<a id='x'/>", "<a href='/y'>link"):
        assert body in main_text(f"<body><article>{anchor}<p>{body}</p></article></body>")
    links = "".join(f"<p><a href='/{i}'>Source {i}</a></p>" for i in range(4))
    assert all(f"Source {i}" in main_text(f"<article><p>{body}</p>{links}</article>") for i in range(4))
    page = f"<body><p>{body}</p><nav>menu</nav><h2>Short</h2><nav>menu</nav><p>{body}</p></body>"
    assert main_text(page).split("\n\n") == [body, "Short", body]


def test_exact_dedup_when_the_scan_is_split_anew(spark, tmp_path):
    from shokuba.llm.exact_dedup import drop_exact_duplicates

    path = str(tmp_path / "docs")
    docs(spark, [(i, f"text {i % 60}") for i in range(120)]).repartition(8).write.parquet(path)
    kept = drop_exact_duplicates(spark.read.parquet(path))
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "16")
    try:
        got = [(x.doc_id, x.text) for x in kept.collect()]
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(got) == sorted((i, f"text {i}") for i in range(60))


def test_components_match_brute_force(spark):
    from shokuba.llm.simhash import link_fingerprints, near_duplicates

    r, fps = random.Random(5), set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(25):  # chains and balls around each base
            fps.add(base)
            for b in r.sample(range(64), r.randrange(0, 4)):
                base ^= 1 << b
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {x.fp: x.component_fp for x in link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), len(fps)).collect()}
    assert all(got.get(x, x) == find(x) for x in fps)
    rows = near_duplicates(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert {x.component_id for x in rows if x.doc_id in (1, 2, 3)} == {1}
    assert near_duplicates(docs(spark, [])).count() == 0


def test_similar_documents_by_shingle_similarity(spark):
    from shokuba.llm.simhash import drop_near_duplicates, similar_documents

    def jaccard(a, b):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    r, rows = random.Random(4), []
    for g in range(25):
        base = words(400, 900 + g).split()
        rows.append((g * 10, " ".join(base)))
        for c, edits in ((1, 4), (2, 6), (3, 60)):
            w = list(base)
            for p in r.sample(range(400), edits):
                w[p] = "changed"
            rows.append((g * 10 + c, " ".join(w)))
    assert all(jaccard(rows[i][1], rows[i + 1][1]) > 0.85 and jaccard(rows[i][1], rows[i + 3][1]) < 0.5 for i in range(0, 100, 4))
    got = {x.doc_id: x.component_id for x in similar_documents(docs(spark, rows)).collect()}
    near = [got[g * 10 + c] == g * 10 for g in range(25) for c in (1, 2)]
    assert sum(near) >= 48 and all(got[g * 10 + 3] == g * 10 + 3 for g in range(25))
    kept = drop_near_duplicates(docs(spark, rows + [(None, "a b")]))
    assert 51 <= kept.count() <= 53 and kept.columns == docs(spark, []).columns
    assert drop_near_duplicates(docs(spark, [])).count() == 0


def test_pipeline_links_fingerprints(spark):
    """Repeats weigh in a fingerprint but not in a set of shingles, so only fingerprints link these two."""
    import corpus_pipeline
    from shokuba.llm.simhash import drop_near_fingerprints, near_duplicates

    rows = [(5, "ja " * 200 + "one"), (3, "ja " * 200 + "two"), (9, words(80, 1)), (None, "a b"), (None, "c d")]
    found = near_duplicates(docs(spark, rows)).collect()
    assert {x.component_id for x in found if x.doc_id in (3, 5)} == {3}
    for got in (drop_near_fingerprints(docs(spark, rows)), corpus_pipeline.near_dedup(spark, docs(spark, rows), "")):
        assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 3, 9]
    assert drop_near_fingerprints(docs(spark, [])).count() == 0


def test_similar_documents_recall_near_the_bound(spark):
    from shokuba.llm.simhash import similar_documents

    def shingles(t):
        return {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}

    r, rows = random.Random(7), []
    for g in range(400):
        base = words(300, 5000 + g).split()
        w = list(base)
        for p in r.sample(range(300), r.randrange(5, 9)):
            w[p] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
    near = {}
    for g in range(400):
        x, y = shingles(rows[2 * g][1]), shingles(rows[2 * g + 1][1])
        near[g] = len(x & y) / len(x | y)
    got = {x.doc_id: x.component_id for x in similar_documents(docs(spark, rows)).collect()}
    found = {g: got[2 * g + 1] == 2 * g for g in near}
    close = [found[g] for g, s in near.items() if 0.8 <= s <= 0.85]
    assert len(close) >= 100 and sum(close) >= 0.97 * len(close)
    assert not any(found[g] for g, s in near.items() if s < 0.8) and min(near.values()) < 0.78


# -- substring dedup


def brute_repeats(rows, window):
    count = Counter()
    for _, t in rows:
        w = (t or "").encode().split()
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark):
    from shokuba.llm.substring_dedup import remove_repeats

    p, q = words(50, 11), words(40, 12)
    rows = ODD + [(20, f"{words(30, 3)} {p} {words(5, 4)}"), (21, f"{p} {q}"), (22, f"{q} x {p[:100]} {q}"), (23, "ab " * 90), (24, words(34, 9)), (25, words(34, 9)), (26, words(35, 8)), (27, words(35, 8) + " z")]
    for window, k in ((35, 8), (12, 3)):
        got = sorted((tuple(r) for r in remove_repeats(docs(spark, rows), window, k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
        assert got == brute_repeats(rows, window)
    assert remove_repeats(docs(spark, [])).count() == 0
    kept = {r.doc_id: r.kept for r in remove_repeats(docs(spark, rows), keep_text=True).filter("doc_id >= 20").collect()}
    assert kept[23] == "" and kept[24] == words(34, 9)


# -- packing


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_tokenizer():
    from shokuba.llm.tokens import WordEncoder

    e = WordEncoder(tokenizer_path(), words=50, units=50)
    for t in ["", "Don't WE'LL x²³ 12a ..!! ok", "İstanbul ŞAŞ", "<|endoftext|> a", "a\x1cb c\x85d\xa0e", "Σας ΟΔΟΣ é 日本語!!", "soft\xadhy", words(300)]:
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    from shokuba.llm.packing import pack
    from shokuba.llm.tokens import WordEncoder

    rows = [(i, t) for i, t in ODD if i not in (6, None)] + [(100 + i, words(200 + 37 * i, i) + ". " + words(90, i)) for i in range(30)]
    got = pack(docs(spark, rows).coalesce(1), tokenizer_path(), capacity=512).collect()
    e = WordEncoder(tokenizer_path())
    for i, t in rows:
        ids, at = np.append(e.encode(t or ""), np.uint32(2)), 0
        for p in sorted((p for p in got if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for s in {p.sequence_id for p in got}:
        pieces, at = sorted((p for p in got if p.sequence_id == s), key=lambda p: p.offset), 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= 512
        total += at
        padding += 0 if at & (at - 1) == 0 else 512 - at
    assert padding / total < 0.03
    order = [p.doc_id for p in sorted(got, key=lambda p: (p.sequence_id, p.offset))]
    assert list(dict.fromkeys(order)) == [i for i, _ in rows]
    assert pack(docs(spark, ODD), tokenizer_path()).filter("doc_id is null and start = 0").count() == 2
    assert pack(docs(spark, []), tokenizer_path()).count() == 0


def test_plan_is_optimal():
    from shokuba.llm.packing import plan_cuts, tail_cost

    r = random.Random(3)
    for _ in range(30):
        at = np.cumsum([r.randrange(1, 9) for _ in range(12)])
        cost = np.array([r.choice((0.0, 2.0)) for _ in at])
        places, price = [0, *at.tolist()], [0.0, *cost.tolist()]
        best = {0: 0.0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + 16 - (places[j] - places[i]) + price[j] for i in range(j) if places[j] - places[i] <= 16)
        want = min(best[j] + tail_cost(places[-1] - places[j], 16) for j in best if places[-1] - places[j] < 16)
        cuts = [0, *plan_cuts(at, cost, 16, True)]
        got = sum(16 - (b - a) + price[places.index(b)] for a, b in zip(cuts, cuts[1:])) + tail_cost(places[-1] - cuts[-1], 16)
        assert abs(got - want) < 1e-9


# -- decontamination


def test_leaks_are_found_and_clean_documents_left(spark):
    from shokuba.llm.decontaminate import drop_leaks, find_leaks

    items = [(i, words(20 + i, 1000 + i)) for i in range(20)] + [(90, None), (91, ""), (92, words(300, 77))]
    rows = list(ODD)
    for i, t in items[:20]:
        w = t.split()
        rows.append((100 + i, f"{words(80, i)} {t.upper()}, {words(50, i + 1)}"))
        w[len(w) // 2] = "changed"
        rows.append((200 + i, f"{words(10, i)} {' '.join(w)}"))
        rows.append((300 + i, words(150, 5000 + i)))
    rows += [(400, f"{words(9, 3)} {words(300, 77)} {words(9, 4)}"), (401, words(300, 77)[:700])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs(spark, rows), bench).collect()}
    assert {(100 + i, i) for i in range(20)} | {(400, 92)} <= found and (401, 92) not in found
    assert len({(200 + i, i) for i in range(20)} & found) >= 18
    assert all(d // 100 in (1, 2, 4) for d, _ in found)
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs(spark, rows), bench, block_chars=700).collect()} >= {(100 + i, i) for i in range(20)}
    clean = drop_leaks(docs(spark, rows), bench)
    assert clean.filter("doc_id between 300 and 399").count() == 20 and clean.filter("doc_id between 100 and 199").count() == 0
    assert clean.filter("doc_id is null").count() == 2 and clean.columns == docs(spark, []).columns
    assert find_leaks(docs(spark, rows), bench.limit(0)).count() == 0 and find_leaks(docs(spark, []), bench).count() == 0


def test_recall_on_edited_items():
    from shokuba.llm.decontaminate import Bands, ItemIndex

    items = [(i, words(30, 2000 + i)) for i in range(100)]
    index, r, hit = ItemIndex(items, Bands()), random.Random(1), 0
    for i, t in items:
        w = t.split()
        for k in range(4):
            w[r.randrange(len(w))] = f"edit{k}"
        hit += any(h[0] == i for h in index.search(f"{words(40, i)} {' '.join(w)} {words(40, i + 7)}"))
    assert hit >= 90


def test_best_edits():
    from shokuba.llm.decontaminate import best_edits

    a = np.array
    assert best_edits(a([1, 2, 3]), a([9, 1, 2, 3, 9])) == 0
    assert best_edits(a([1, 2, 3]), a([9, 1, 3, 9])) == 1
    assert best_edits(a([1, 2, 3]), a([0, 0, 0])) == 3
    assert best_edits(a([1, 2, 3]), a([], dtype=np.int32)) == 3


# -- language


def test_language_held_out_accuracy(spark):
    from shokuba.llm.language import identify, keep_known_languages, language_id, train

    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id(df.select("doc_id", "text", "lang").unionByName(docs(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 !!"), (10**6 + 3, "x")]).select("doc_id", "text", F.lit(None).cast("string").alias("lang")))).filter("doc_id >= 1000000").collect()}
    assert [odd[10**6 + i].lang_pred for i in range(3)] == ["und"] * 3 and odd[10**6 + 3].lang_pred != "und"
    assert language_id(docs(spark, [])).count() == 0
    rows = df.filter("lang in ('en', 'de')").select("lang", "text").collect()
    text = {x: next(r.text for r in rows if r.lang == x and len(r.text) > 900)[:900] for x in ("en", "de")}
    mixed = identify(docs(spark, [(1, text["en"] + " " + text["de"])]), train(df)).first()
    assert sorted(mixed.languages) == ["de", "en"] and abs(sum(mixed.shares) - 1) < 1e-5
    kept = keep_known_languages(docs(spark, [(i, f"word {words(5, i)}") for i in range(9)] + [(50, None)]))
    assert kept.count() == 9 and kept.columns == docs(spark, []).columns


# -- quality


def test_quality_held_out(spark):
    from shokuba.llm.quality import score_documents

    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = score_documents(d, lab).join(lab, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(a > b for a in good for b in bad) >= 0.9 * len(good) * len(bad)
    odd = score_documents(docs(spark, ODD), lab.limit(0)).collect()
    assert len(odd) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in odd)
    assert all(0 <= r.score <= 1 for r in score_documents(docs(spark, ODD), lab).collect())


# -- html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""), ("<p>a &lt; b&nbsp;&amp;\n c</p>", "a < b & c"),
        ("<article><h1>T</h1><p>one<p>two <b>three</b><script>x</script></article><footer>f</footer>", "T\n\none\n\ntwo three"),
        ("<div class='ad'>buy <div>now</div> more</div><main><p>" + "long text " * 9 + "</p><p>end</p></main><div id='comments'><article>" + "I think so " * 9 + "</article></div>", ("long text " * 9).strip() + "\n\nend"),
        ("<div class='page has-sidebar'><p>" + "kept text " * 6 + "</p><div class='sidebar'>not this</div></div>", ("kept text " * 6).strip()),
        ("<article><p>cut off in a tag</p><a hre", "cut off in a tag"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ],
)
def test_main_text(page, text):
    from shokuba.llm.html_text import main_text

    assert main_text(page or "") == text


def test_pages(spark):
    from shokuba.llm.html_text import extract_pages

    df = spark.createDataFrame([(1, "u", None, 5), (None, None, "<p>né</p>", 6), (1, "u", "<p>" + "x" * 200_000, 7)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in extract_pages(df).collect()) == [0, 2, 200_000]
    assert extract_pages(df.limit(0)).count() == 0


# -- urls


def test_url_rules_and_cascade(spark):
    from shokuba.llm.url_filter import Cascade, judge_pages, parts_for

    assert parts_for(1, 9, 8) > 1 == parts_for(0, 9, 8)

    urls = [None, "", "nohost", "http://A.Example.ORG/es/x?y", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/#a", "http://www.spam-farm.net", "http://ok.net/p", "x://h?/de/"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_pages(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5][2:] == ("org/", "allow") and got[6][2:] == ("com/fr/", "allow") and got[7][1:] == ("/de/", "com/de/", "block")
    assert got[8] == ("www.spam-farm.net", "", None, "block") and got[9][3] == "allow" and got[10] == ("h", "", None, "allow")
    assert {r.page_id: r.verdict for r in judge_pages(df, max_bits=8).collect()} == {k: v[3] for k, v in got.items()}
    assert judge_pages(df.limit(0)).count() == 0
    universe = spark.range(4000).select(F.concat(F.lit("h"), F.col("id")).alias("key"))
    listed = universe.filter(F.xxhash64("key") % 7 == 0)
    cascade = Cascade(universe, listed, rate=0.3)
    assert len(cascade.levels) > 2
    said = universe.filter(cascade.listed(F.col("key")))
    assert said.count() == listed.count() and said.join(listed, "key", "left_anti").count() == 0


# -- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_match_the_patterns(spark):
    from shokuba.llm.pii import find_personal_data, redact

    r = random.Random(9)
    texts = [t for _, t in ODD] + [
        "a@b.c@d.e f..g@h.i. j@k x@y.z..w a@b.c..d@e.f a@-.- %@a.b-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 0000.0.0.0", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 11111111",
        "+1 (988) 555-2485 +44 20 7946 0958. +1 +12 +1-2 ++49 30 123456-", "日本 +81 3 1234 5678 é a@b.co", "a." * 5000 + "@" + "b." * 5000 + "c", "1" * 20_000, "1 " * 20_000, "x@" * 3000,
    ]
    texts += ["".join(r.choices("a1.@+- ()4\x01\x02", k=60)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in find_personal_data(docs(spark, rows), fit=False).collect()}
    for i, t in rows:
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].spans == want, t
    assert find_personal_data(docs(spark, [])).count() == 0
    hidden = redact(docs(spark, [(1, "mail a@b.co now"), (2, None), (3, "none")])).collect()
    assert [x.text for x in sorted(hidden, key=lambda x: x.doc_id)] == ["mail ****** now", None, "none"]


def test_boosted_spans_only_add(spark):
    from shokuba.llm.pii import find_personal_data

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with_model, plain = (find_personal_data(df, fit=f).select("doc_id", "base_sha256", "spans").collect() for f in (True, False))
    base = {r.doc_id: r for r in plain}
    for r in with_model:
        assert r.base_sha256 == base[r.doc_id].base_sha256
        assert set(filter(None, base[r.doc_id].spans.split(","))) <= set(r.spans.split(","))


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    df = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    path = "/tmp/spark-pipe-" + words(1, random.randrange(10**9))
    df.unionByName(df.limit(5).withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(df.limit(1).select(F.lit(10**7).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")).write.parquet(path)
    now = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == now.columns and 0 < after.count() <= now.count(), name
        step = f"{path}-{name}"
        after.write.parquet(step)
        now = spark.read.parquet(step)
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    assert max(ids) < 10**6
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).select("doc_id").collect()} == ids
    con = duckdb.connect()
    items = [t for (t,) in con.execute(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    for r in now.select("text").collect():
        flat = " ".join(r.text.split())
        assert not any(" ".join(t.split()) in flat for t in items)


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    import shutil

    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `fp` long, `lang_pred` string, `component_id` long"
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(None, None, None, None, 0, "a", 1, "z", 9), (1, "", "en", "s", 0, "a", 1, "z", 9), (2, "the same words here and there", "en", "s", 9, "a", 1, "z", 9), (2, "the same  words here and there", "en", "s", 9, "b", 2, "y", 8), (2, "other words", "de", None, 9, "b", 2, "y", 8), (3, long, "en", "s", 9, "a", 1, "z", 9), (4, "!!! 123", "en", "s", 9, "a", 1, "z", 9)]
    rows += [(i, words(40, i), "en", "s", 9, "a", 1, "z", 9) for i in range(20, 32)]
    for name, table in (("empty", []), ("odd", rows)):
        folder = tmp_path / name
        folder.mkdir()
        shutil.copy(f"{SF}/benchmark.parquet", folder / "benchmark.parquet")
        spark.createDataFrame(table, schema).write.parquet(str(folder / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in got} == ({2, 3, *range(20, 32)} if table else set())
    now = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path / "odd"))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "fp", "lang_pred", "component_id"]
    assert sorted((r.doc_id, r.text[:5]) for r in now.collect() if r.doc_id < 20) == [(2, "other"), (2, "the s"), (3, long[:5])]


def edited(text, shares, rng):
    w = text.split()
    for _ in range(shares):
        w[rng.randrange(len(w))] = f"q{rng.randrange(10**9)}"
    return " ".join(w)


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_duplicates_at_the_similarity(spark):
    from shokuba.llm.simhash import similar_documents

    rng = random.Random(11)
    pairs = []
    while len(pairs) < 300:
        a = " ".join(f"v{rng.randrange(10**6)}" for _ in range(200))
        b = edited(a, 4, rng)
        if 0.8 <= jaccard(a, b) < 0.86:
            pairs.append((a, b))
    rows = [(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    got = {r.doc_id: r.component_id for r in similar_documents(docs(spark, rows)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(len(pairs))) >= 0.97 * len(pairs)


def test_a_family_below_the_similarity_makes_no_square_of_rows(spark, monkeypatch):
    from shokuba.llm import simhash

    rng = random.Random(12)
    base = " ".join(f"v{rng.randrange(10**6)}" for _ in range(200))
    rows = [(i, edited(base, 9, rng)) for i in range(600)]
    sizes, plain = [], simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name: (out := plain(df, name), sizes.append(out.count()))[0])
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, rows)).collect()}
    assert max(sizes) < 60 * len(rows)
    links = [(i, j) for i in range(0, 600, 7) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    assert all(got[i] == got[j] for i, j in links)


def test_fingerprints_of_one_bucket(spark):
    from shokuba.llm.simhash import link_fingerprints

    rng = random.Random(13)
    fps = sorted({(rng.getrandbits(24) << 40 | 0x123456789A) - (1 << 63) for _ in range(1500)})
    fps += [f ^ 0b1011 for f in fps[:40]]
    n = len(fps)
    got = {r.fp: r.component_fp for r in link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), n).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(got.get(f, f) == find(f) for f in fps)


def test_whole_items_are_verified(spark):
    from shokuba.llm.decontaminate import ItemIndex, Bands

    rng = random.Random(14)
    item = [f"w{rng.randrange(5000)}" for _ in range(300)]
    index = ItemIndex([(1, " ".join(item))], Bands())
    assert index.search(" ".join(item[:64])) == []  # a part of an item isn't the item
    found = index.search(" ".join(["x"] * 50 + item[:100] + ["y"] * 5 + item[110:]))
    assert [(r[0], r[2]) for r in found] == [(1, 300)] and found[0][3] == 10


def test_html_forms_formulas_and_time():
    import time

    from shokuba.llm.html_text import main_text

    text = "This is the main text, and it is long enough. " * 4
    assert main_text(f"<form><h1>Head</h1><p>{text}</p></form>") == f"Head\n\n{text.strip()}"
    assert main_text("<article><p>Let <math><mi>x</mi></math> be.</p></article>") == "Let x be."
    assert main_text(f"<div><a href=1>Home</a></div><p>{text}</p><div><a href=2>Imprint</a></div><div>© 2020 Foo</div>") == text.strip()
    began = time.time()
    main_text("<nav><p>x</p>" * 80_000)
    assert time.time() - began < 10


def test_added_spans(spark):
    from shokuba.llm.pii import find_personal_data, train

    df = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    model = train(df)
    probes = ["write anna (at) example (dot) com now", 'the token = "f33e61083db5dbdf4bd2369d2f"', "from 1999-2003 it was", "Donaudampfschifffahrtsgesellschaft", "", None]
    got = {r.doc_id: r.spans for r in find_personal_data(docs(spark, list(enumerate(probes))), model).collect()}
    assert got == {0: "other:6:33", 1: "other:13:39", 2: "", 3: "", 4: "", 5: ""}
    planted = df.filter(F.col("text").rlike('token = "[0-9a-f]{40}"'))
    assert planted.count() > 0 and find_personal_data(planted, model).filter("spans like '%other%'").count() == planted.count()
