"""Each operator on odd rows: nulls, empty texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clearbrook.llm import chat, decontaminate, langid, pieces, pii, quality, sharding, simhash, toxicity, urls
from clearbrook.llm.components import components

SCHEMA = "doc_id long, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, text(i, 60)) for i in range(30)] + [(100, None), (101, ""), (102, "  \n\t"), (None, "alone"), (None, None), (5, text(5, 60)), (5, text(5, 60)), (103, "x" * 30_000), (104, "word " * 5_000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


# -- sharding ----------------------------------------------------------------------------------------------------


def test_shards_hold_every_row_with_gapless_slots(odd):
    rows = sharding.shuffle_into_shards(odd, bucket_bytes=4096).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert all(len({r.shard for r in rows if r.doc_id == k}) == 1 for k in {r.doc_id for r in rows})
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)


def test_equal_rows_of_one_partition_are_dealt_over_all_buckets(spark):
    out = sharding.shuffle_into_shards(spark.createDataFrame([(None, "the same text")] * 400, SCHEMA).coalesce(1), shards=2, bucket_bytes=400)
    sizes = [r["count"] for r in out.groupBy("shard", "bucket").count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 4 and max(sizes) < 120
    assert sorted(r.slot for r in out.collect()) == list(range(400))


def test_shards_are_repeatable_shuffled_and_keep_clashing_columns(spark, odd, tmp_path):
    a = sharding.shuffle_into_shards(odd).select("doc_id", "text", "shard", "slot").collect()
    b = sharding.shuffle_into_shards(odd).select("doc_id", "text", "shard", "slot").collect()
    assert Counter(a) == Counter(b)
    df = spark.createDataFrame([(i, "t", 7) for i in range(200)], "doc_id long, text string, shard int")
    out = sharding.shuffle_into_shards(df, shards=2)
    assert {r.shard_in for r in out.collect()} == {7}
    ids = [r.doc_id for r in out.where("shard = 0").orderBy("slot").collect()]
    assert ids != sorted(ids)
    sharding.write_shards(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert sharding.shuffle_into_shards(df.limit(0)).count() == 0


# -- simhash -----------------------------------------------------------------------------------------------------


def plain_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, tau):
    ids, left = {}, set(prints)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x in group:
                continue
            group.add(x)
            todo += [y for y in left if (x ^ y).bit_count() <= tau and y not in group]
        left -= group
        ids |= dict.fromkeys(group, frozenset(group))
    return ids


@pytest.mark.parametrize("longest", [2048, 2])
def test_links_against_brute_force(spark, longest):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(6)} | set(base) | {0, 1, 3, 7, 15, (1 << 64) - 1}
    signed = [(p - (1 << 64) if p >> 63 else p) for p in prints]
    nodes = spark.createDataFrame([(p, p) for p in signed], "fp long, node long").repartition(3)
    roots = {x.node: x.root for x in components(simhash.near_links(nodes, 2, longest)).collect()}
    want = plain_components(prints, 2)
    got = {}
    for p, s in zip(prints, signed, strict=True):
        got.setdefault(roots.get(s, s), set()).add(p)
    assert {frozenset(g) for g in got.values()} == set(want.values())


def test_hamming_components_of_odd_rows(spark, odd):
    rows = simhash.hamming_components(odd).collect()
    assert len(rows) == odd.count()
    prints = {plain_print(r.text) for r in odd.collect()}
    groups = plain_components(prints, 2)
    least = {}
    for r in odd.collect():
        g = groups[plain_print(r.text)]
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{plain_print(r.text):016x}", least.get(groups[plain_print(r.text)])) for r in odd.collect())
    assert Counter(map(tuple, rows)) == want
    assert simhash.hamming_components(odd.limit(0)).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark):
    base = text(1, 200).split()
    near = [*base]
    near[50] = "changed"
    far = [w if i % 6 else "other" + str(i) for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(far)), (5, text(9, 200)), (6, ""), (7, None)]
    out = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, r in out.items() if r.keep} == {1, 4, 5, 6}
    assert out[1].group_id == out[2].group_id == out[3].group_id and out[6].group_id == out[7].group_id


@pytest.mark.parametrize("longest", [simhash.RUN, 6])
def test_near_duplicates_of_gained_lost_and_edited_blocks_against_brute_force(spark, longest):
    r = random.Random(11)
    rows = []
    for i in range(60):
        n = r.randrange(100, 300)
        base = text(1000 + i, n).split()
        edited = [w if k % 40 else f"edit{i}x{k}" for k, w in enumerate(base)]
        block = text(5000 + i, int(n * (0.17 + 0.12 * (i % 2)))).split()
        rows += [" ".join(x) for x in (base, base + block, base[int(n * 0.18) :], base[: n // 2] + block + base[n // 2 :], edited)]
    rows += [" ".join(text(9000 + i, 12).split() + "one line that very many of these texts have in common at the end".split()) for i in range(60)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in rows]
    near = {i: {j for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in range(len(rows))}
    group = {}
    for i in near:
        todo = [] if i in group else [i]
        while todo:
            if (x := todo.pop()) not in group:
                group[x] = i
                todo += near[x]
    out = {x.doc_id: x.group_id for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3), longest=longest).collect()}
    assert len(set(group.values())) < len(rows) - 60
    assert {frozenset(i for i in out if out[i] == g) for g in out.values()} == {frozenset(i for i in group if group[i] == g) for g in group.values()}


def test_sketches_never_differ_by_more_than_the_sets():
    r = np.random.default_rng(5)
    for n in (3, 60, 70, 500, 3000):
        x = r.integers(0, 1 << 62, n).astype(np.uint64)
        others = [np.concatenate((x[k:], r.integers(0, 1 << 62, k + extra).astype(np.uint64))) for k in (0, 1, n // 9, n // 3) for extra in (0, n // 5)]
        table = simhash.SketchTable(__import__("pyarrow").array([simhash.parity_sketch(y) for y in (x, *others)]))
        bits = table.differ(np.zeros(len(others), dtype=int), np.arange(1, len(others) + 1))
        apart = [len(set(x.tolist()) ^ set(y.tolist())) for y in others]
        assert all(b <= a for b, a in zip(bits.tolist(), apart, strict=True)) and bits[0] == 0
        assert n < 60 or bits[4] > 0.7 * apart[4]


def test_thresholds_add_up():
    r = np.random.default_rng(0)
    x = (r.random((500, 64)) < np.linspace(0.1, 0.9, 64)).astype(float)
    for tau in (0, 2, 5):
        plan = simhash.plan_parts(500, x.T @ x, tau)
        assert all(len(set(b)) == len(b) for b, _ in plan)
        assert sum(t + 1 for _, t in plan) == tau + 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(51)} == {0} and {roots[1000 + i] for i in range(40)} == {1000}


# -- language ----------------------------------------------------------------------------------------------------


def test_language_backs_off_and_knows_nothing_of_digits(spark):
    rows = [("the cat and the dog with a house", "en"), ("der hund und die katze mit einem haus", "de"), ("les chiens et les chats avec une maison", "fr"), (None, "en"), ("no label", None)] * 3
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([(1, "the cat"), (2, "katzen haus"), (3, "chatss maisonn"), (4, "123 456"), (5, None), (6, "")], SCHEMA)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert [out[i][0] for i in range(1, 7)] == ["en", "de", "fr", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in out.values()) and "katzen" not in model.words


def test_language_without_training_rows(spark):
    model = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert langid.identify(spark.createDataFrame([(1, "abc")], SCHEMA), model).first().lang_pred == "und"


def test_a_language_with_one_row_takes_no_text_of_others(spark):
    r = random.Random(3)
    vocabulary = {x: [f"{x}{c}{d}{e}" for c in "abcdefghij" for d in "klmnopqrst" for e in "uvwxy"] for x in ("en", "fr")}
    write = lambda x, n: " ".join(r.choice(vocabulary[x]) for _ in range(n))
    rows = [(write(x, 40), x) for x in ("en", "fr") for _ in range(150)] + [("hola mundo casa perro", "es")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    rare = langid.train(spark.createDataFrame(rows, "text string, lang string"), rows=60)
    texts = [(i, write(x, 30), x) for i, x in enumerate(["en", "fr"] * 30)] + [(99, "hola perro mundo", "es")]
    for m in (model, rare):
        assert {"hola", "mundo", "casa", "perro"} <= set(m.words.at)
        assert all(m.classify(t, langid.Memory())[0] == x for _, t, x in texts)
    assert model.classify("q" * 40 + "hola" + "q" * 60, langid.Memory())[0] == "es"


def test_scores_follow_the_rule(spark):
    r = random.Random(8)
    rows = [(" ".join(r.choice(("ab", "abc", "b", "cab", "dab")) for _ in range(12)), r.choice("xyz")) for _ in range(60)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    counts = {x: Counter(w for t, lang in rows if lang == x for w in t.split()) for x in "xyz"}
    grams = {x: Counter() for x in "xyz"}
    for x in "xyz":
        for w, k in counts[x].items():
            for i in range(len(w)):
                grams[x][f" {w} "[i : i + 3]] += k

    def logs(of, entry):
        total = {x: sum(of[x].values()) for x in "xyz"}
        p = [0.01 * sum(of[y][entry] for y in "xyz") / sum(total.values()) + 0.99 * of[x][entry] / total[x] for x in "xyz"]
        return np.log(p) - np.log(max(p))

    assert np.allclose(model.word_scores("cab"), logs(counts, "cab"), atol=1e-5)
    assert np.allclose(model.word_scores("xabx"), np.mean([model.ngrams[1].table[model.ngrams[1].at["ab"]]], axis=0), atol=1e-5)
    assert np.allclose(model.ngrams[2].table[model.ngrams[2].at["ab "]], logs(grams, "ab "), atol=1e-5)


def test_odd_tables_of_languages(spark, odd):
    model = langid.train(spark.createDataFrame([("hello there", "en"), ("bonjour", "fr")], "text string, lang string"))
    df = spark.createDataFrame([(1, "½ ² ① ٣ 一", "x"), (2, "½ ² ① 12", "x"), (3, "hello " * 50_000, "x")], "doc_id long, text string, score string")
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert out[2].lang_pred == "und" and out[1].lang_pred != "und" and out[3].lang_pred == "en" and out[1].score_in == "x"
    assert langid.identify(odd.limit(0), model).count() == 0 and langid.identify(odd, model).count() == odd.count()


# -- chat --------------------------------------------------------------------------------------------------------


def test_each_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "ann", "bye"), (1, 700, "cid", "late"), (None, 1, "ann", "lost"), (2, 0, "system", "only"), (3, 1, None, "x")]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    views = {(r.conv_id, r.perspective) for r in out}
    assert views == {(1, "ann"), (1, "bob"), (1, "cid"), (None, "ann"), (3, "unknown")}
    for v in views:
        seen = sorted((r for r in out if (r.conv_id, r.perspective) == v), key=lambda r: r.position)
        whole = "".join(r.segment for r in seen)
        assert [r.position for r in seen] == list(range(len(seen)))
        for r in seen:
            assert whole[r.start : r.end] == r.segment
            assert (r.mask_start is not None) == (r.speaker == v[1])
            if r.mask_start is not None:
                assert whole[r.mask_start : r.mask_end].endswith("<|im_end|>\n") and r.view_role == "assistant"
    assert sum(r.conv_id == 1 and r.perspective == "ann" for r in out) == 6


# -- decontamination ---------------------------------------------------------------------------------------------


def test_contained_items_against_brute_force(spark, odd):
    items = [(i, " ".join(text(i, 60).split()[10:30]).upper() + "!") for i in range(5)] + [(50, "alone"), (51, None), (52, ""), (0, " ".join(text(0, 60).split()[10:30]))]
    items += [(60 + k, " ".join(text(7, 60).split()[:n] + text(99, 40).split()[: 30 - n])) for k, n in enumerate((5, 20, 26, 28))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    items += [(70, " ".join(text(3, 60).split()[4:7])), (71, text(3, 60).split()[5].upper()), (72, " ".join(text(3, 60).split()[8:4:-1]))]  # short ones inside long texts
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d in odd.collect():
        w = decontaminate.words_of(d.text)
        for i, t in items:
            v = decontaminate.words_of(t)
            n = min(5, len(v))
            s, own = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (v, w))
            if n and len(s & own) >= 0.8 * len(s):
                want[(d.doc_id, i, len(s), len(s & own))] += 1
    assert any(k[1] == 70 for k in want) and any(k[1] == 71 for k in want)
    for most in (decontaminate.BROADCAST_BYTES, 0):
        out = decontaminate.find_contaminated(odd, bench, most_bytes=most).select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.*")
        assert Counter(map(tuple, out.collect())) == want
    assert decontaminate.find_contaminated(odd, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.find_contaminated(odd.limit(0), bench).count() == 0
    clash = decontaminate.find_contaminated(odd.withColumn("items", F.lit(5)), bench, most_bytes=0)
    assert {r.items_in for r in clash.collect()} == {5} and clash.count() == odd.count()


# -- pieces ------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    model = pieces.load_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", " ", "  a  b ", "▁", "\n\n x", "日本語 😀é", "<s> <0x41>", "ab" * 3000, " " * 70, "Ünïcödé token 12345", "\x00", *[text(i, 40) for i in range(5)]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], SCHEMA)
    for r in pieces.decode_ids(pieces.encode_texts(df, model), model).collect():
        t = r.text or ""
        assert r.ids == sp.encode(t) and r.decoded == sp.decode(r.ids)
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
    spans = {r.doc_id: hashlib.sha256(np.array([*r.starts, *r.ends], "<u4").tobytes()).hexdigest() for r in pieces.encode_texts(df, model).collect()}
    for r in pieces.digest_texts(df, model).collect():  # the query's digests are those of the encoding with its spans
        t = r.text or ""
        assert (r.n_tokens, r.spans_sha256) == (len(sp.encode(t)), spans[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(t)).encode()).hexdigest()
    clash = df.withColumnRenamed("text", "ids").withColumn("starts", F.lit("own"))
    assert {r.doc_id: (r.starts_in, r.ids_in, len(r.starts)) for r in pieces.encode_texts(clash, model, text="ids").collect()} == {r.doc_id: ("own", r.text, len(sp.encode(r.text or ""))) for r in df.collect()}


def test_names_that_operators_use_come_through(spark):
    """Columns named like an output or a temporary column of an operator are found again."""
    names = ["_first", "_rest", "_g", "_g0", "_node", "_won", "_row", "_hits", "_text", "score", "predicted", "block", "key"]
    df = spark.createDataFrame([(i, text(i % 3, 60), *[f"{n}{i}" for n in names]) for i in range(4)], ["doc_id", "text", *names])
    want = sorted(map(tuple, df.select(*names).collect()))
    same = lambda out, held: sorted(map(tuple, out.select(*[held.get(n, n) for n in names]).collect())) == want
    assert same(urls.filter_urls(df.withColumn("url", F.lit("http://a.com/x")), urls.rules_frame(spark, urls.RULES)), {})
    assert same(quality.judge_quality(df, features=["n_words"]), {})
    assert same(toxicity.score_toxicity(df, toxicity.ToxicityModel({}, 0.0)), {"score": "score_in", "predicted": "predicted_in"})
    near = simhash.near_duplicates(df)
    assert same(near, {"_first": "_first_in", "_node": "_node_in"}) and near.where("keep").count() == 3
    assert toxicity.score_toxicity(df, toxicity.ToxicityModel({}, 0.0), text="score").where("score_in like 'score%'").count() == 4


def test_a_very_long_url_is_judged_whole(spark):
    long = "http://" + "a." * 3000 + "com/en/" + "x/" * 100_000
    rows = [(i, u) for i, u in enumerate([long, long + "?q", "https://example.com/en/7" + "y" * 100_000, "http://net/de/", None])]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_frame(spark, urls.RULES)).collect()}
    assert [got[i].rule for i in range(5)] == ["com/en/", "com/en/", "example.com/en/7", "net/de/", None] and len(got[0].path) == 4 + 200_000


def test_character_map_takes_the_longest_prefix():
    units = [0] * 700  # a trie of "a" -> "x" and "ab" -> "yz", laid out by hand
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (a ^ 512) << 10
    units[512] = 1 << 31
    b = 512 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | (b ^ 20) << 10
    units[20] = 1 << 31 | 2
    import struct

    m = pieces.CharacterMap(struct.pack("<I", 2800) + struct.pack("<700I", *units) + b"x\0yz\0")
    assert m.longest(b"abc", 0) == (b"yz", 2) and m.longest(b"ac", 0) == (b"x", 1) and m.longest(b"ca", 0) is None


# -- quality -----------------------------------------------------------------------------------------------------


def test_features_against_brute_force(odd):
    for r in quality.with_features(odd).collect():
        t = r.text or ""
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_repeat_words == len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})
        assert r.n_dup_lines == len(lines) - len(set(lines))


def test_order_of_rules_changes_no_verdict(odd):
    a = quality.judge_quality(odd, order=list(quality.RULES)).select("doc_id", "kept").collect()
    b = quality.judge_quality(odd).select("doc_id", "kept").collect()
    c = quality.judge_quality(odd, order=list(quality.RULES)[::-1], features=["n_words", "n_lines"]).select("doc_id", "kept").collect()
    assert Counter(a) == Counter(b) == Counter(c) and any(r.kept for r in a) and not all(r.kept for r in a)
    costs = quality.feature_costs(odd, "text", quality.FEATURES)
    assert costs.keys() == set(quality.FEATURES) and min(costs.values()) >= 1
    assert quality.rule_order(odd, costs=costs) == quality.rule_order(odd, costs=costs)


def test_a_rejected_row_skips_later_features(spark):
    rules = {"first": (["n_words"], lambda f: f["n_words"] < 3), "second": (["n_upper"], lambda f: F.raise_error(F.lit("reached")).cast("boolean") | (f["n_upper"] > 0))}
    short, long = (spark.createDataFrame([(1, t)], SCHEMA) for t in ("a b", "a b c d"))
    assert quality.judge_quality(short, rules=rules, order=["first", "second"]).first().rejected_by == "first"
    with pytest.raises(Exception, match="reached"):
        quality.judge_quality(long, rules=rules, order=["first", "second"]).collect()


def test_rules_are_ordered_by_what_is_left_to_them(spark):
    df = spark.createDataFrame([(i, ("UP " * 60 if i % 2 else "word " * 10) if i % 4 else text(i, 60)) for i in range(200)], SCHEMA)
    order = quality.rule_order(df)
    assert all(a[2] / a[1] >= order[-1][2] / order[-1][1] for a in order) and {o[0] for o in order} == set(quality.RULES)
    left = {o[0]: o[2] for o in order}
    assert left["too_short"] > 0.2 and left["repeats_itself"] < 0.9 and quality.judge_quality(df.limit(0)).count() == 0
    clash = df.withColumns({"kept": F.lit(7), "n_words": F.lit(8)})
    assert {(r.kept_in, r.n_words_in) for r in quality.judge_quality(clash, features=["n_words"]).collect()} == {(7, 8)}


# -- urls --------------------------------------------------------------------------------------------------------


def test_urls_against_brute_force(spark, monkeypatch):
    rules = [("com", "/a", "block"), ("x.com", "/a/b", "allow"), ("x.com", "/a", "block"), ("x.com", "", "allow"), ("y.x.com", "/a/b/c", "block"), ("org", "", "block")]
    hosts, paths = ["x.com", "y.x.com", "ax.com", "com", "z.org", "q.net"], ["", "/", "/a", "/a/b", "/a/b/c/d", "/ab", "/b"]
    rows = [(i, f"http://{h.upper()}{p}?q#f") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, "no scheme"), (902, "://"), (0, "http://x.com/a")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_frame(spark, rules)).collect()
    assert len(out) == len(rows)
    monkeypatch.setattr(urls, "BLOCK", 1)  # intervals that are open over many blocks
    assert Counter(urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_frame(spark, rules)).collect()) == Counter(out)
    for r in out:
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == ((max(fit)[2], max(fit)[3]) if fit else (None, "allow")), r


def test_odd_tables_of_urls(spark):
    rules = urls.rules_frame(spark, [("com", "/", "block")])
    df = spark.createDataFrame([("http://a.com/" + "x" * 20_000, "h", "p"), (None, "h", "p")], "url string, host string, path string")
    assert urls.filter_urls(df.limit(0), rules).count() == 0 and urls.filter_urls(df, rules.limit(0)).where("verdict = 'allow'").count() == 2
    out = urls.filter_urls(df, rules).collect()
    assert {(r.host_in, r.path_in) for r in out} == {("h", "p")} and sorted(r.verdict for r in out) == ["allow", "block"]


# -- personal data -----------------------------------------------------------------------------------------------


def test_surrogates_are_consistent_distinct_and_of_the_same_form(spark):
    t = 'ann.1@site.org +1 (499) 555-6503 or 499-555-6503, 4539578763621486, 10.1.2.3, token = "abcdef0123456789", Mr. John SMITH and Mrs. Anna Smith, г-н Иван Петров'
    rows = [(1, t), (2, "again ann.1@SITE.org; 10.1.2.4 SSN 123-45-6789"), (3, None), (4, ""), (5, "nothing 12 here")]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "key").collect()}
    s = {e.type: e.surrogate for e in out[1].entities}
    for secret in ("ann.1@site.org", "555-6503", "4539578763621486", "10.1.2.3", "abcdef0123456789", "SMITH", "Петров"):
        assert secret not in out[1].surrogate_text
    assert out[2].entities[0].surrogate == out[1].entities[0].surrogate
    phones = [e.surrogate for e in out[1].entities if e.type == "phone"]
    assert phones[0].startswith("+1 (") and [c for c in phones[0] if c.isdigit()][1:] == [c for c in phones[1] if c.isdigit()]
    digits = [int(c) for c in s["card"]]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0  # the check digit holds
    names = [e.surrogate.split() for e in out[1].entities if e.type == "name"]
    assert names[0][2].isupper() and names[0][2].lower() == names[1][2].lower() and names[1][1].endswith("a") and not names[0][1].endswith("a")
    assert "Ѐ" <= names[2][1][0] <= "ӿ"
    assert out[3].surrogate_text is None and out[4].surrogate_text == "" and out[5].surrogate_text == "nothing 12 here"


def test_permutations_keep_numbers_apart(spark):
    df = spark.range(1000).select(F.format_string("10.0.%d.%d", F.expr("id div 250"), F.col("id") % 250).alias("ip"), F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    out = df.select(pii._ip("k", F.col("ip")).alias("ip"), pii._digits_permuted("k", "x", F.col("d")).alias("d"))
    assert out.select("ip").distinct().count() == 1000 and out.select("d").distinct().count() == 1000


def test_collisions_are_resolved(spark, monkeypatch):
    small = lambda digest, m: F.concat(F.lit("user"), F.pmod(pii._number(digest, 1), F.lit(40)).cast("string"), F.lit("@mail.example.com"))
    monkeypatch.setattr(pii, "_email", small)
    df = spark.createDataFrame([(i, f"mail u{i}@site.org") for i in range(12)], SCHEMA)
    assert pii.pseudonymise(df, "k").select("surrogate_text").distinct().count() == 12


def test_many_collisions_are_resolved_without_a_list(spark, monkeypatch):
    monkeypatch.setattr(pii, "_email", lambda digest, m: F.lit("user@mail.example.com"))
    monkeypatch.setattr(pii, "_spelled", lambda digest, at, n, script="Latin": F.lit("ba" * n))
    monkeypatch.setattr(pii, "_secret", lambda digest, value: F.lit("abcdef01"))
    rows = [(i, f"mail u{i % 6000}@site.org, password: hidden{i % 6000}xx, Mrs. Anna{chr(97 + i % 26)} Smith{chr(97 + i // 26 % 26)}") for i in range(6100)]
    out = pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").collect()
    assert len(out) == 6100
    for k, n in ((0, 6000), (1, 6000), (2, 676)):
        of = Counter(r.entities[k].id + r.entities[k].surrogate if k < 2 else r.text.split("Mrs.")[1] + r.entities[k].surrogate for r in out)
        assert len(of) == len({r.entities[k].surrogate for r in out}) == n
        assert all(r.entities[k].surrogate in r.surrogate_text for r in out)


def test_whole_secrets_and_ibans_with_letters_are_replaced(spark):
    long, jwt = "aB3_" * 200, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9"
    hidden = [long, jwt, "P@ssw0rd!2024x", "0123456789abcdef" * 8, "sk-" + "a1B2" * 30, "GB29 NWBK 6016 1331 9268 19", "NL91ABNA0417164300", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947"]
    texts = [f"token = {long} end", f"token: {jwt}. Next", f"password: {hidden[2]}, next", f"see {hidden[3]} end", f"use {hidden[4]} end", *[f"pay {x} THIS WEEK" for x in hidden[5:]], "pay GB29NWBK60161331926819 now", "password: secrets@mail.org. Next"]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "k").collect()}
    for i, h in enumerate(hidden):
        assert len(out[i].entities) == 1 and out[i].surrogate_text.split()[-1] == texts[i].split()[-1], texts[i]
        assert len(out[i].surrogate_text) == len(texts[i])
        assert not any(h[k : k + 6] in out[i].surrogate_text for k in range(len(h) - 5)), texts[i]
    assert out[9].entities[0].surrogate == out[5].entities[0].surrogate.replace(" ", "") and out[9].entities[0].id == out[5].entities[0].id
    assert [e.type for e in out[10].entities] == ["secret"] and out[10].surrogate_text.endswith(". Next") and out[7].surrogate_text.endswith(" THIS WEEK")


def iban_remainder(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_check_digits_classes_and_later_mentions(spark):
    ibans = ["GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606", "GB30 NWBK 6016 1331 9268 19"]
    ips = ["10.1.2.3", "192.168.0.1", "172.20.1.1", "172.40.1.1", "8.8.8.8", "192.0.2.1", "100.70.1.1", "169.254.3.4", "224.1.1.1"]
    rows = [(i, f"pay {x} now") for i, x in enumerate(ibans)] + [(100 + i, f"host {x} up") for i, x in enumerate(ips)]
    rows += [(200, "Mr. John Smith came. Later John Smith, Smith's son and Smithson left."), (201, "Frau Anna Schmidt and Dr. Anna Schmidt"), (202, "Dr. Anna Schmidt"), (203, "Frau Dr. Anna-Lena O'Brien is here")]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    for i, x in enumerate(ibans):
        made = out[i].entities[0].surrogate
        assert made[:2] == x[:2] and [c.isdigit() for c in made] == [c.isdigit() for c in x] and made != x
        assert (iban_remainder(made) == 1) == (iban_remainder(x) == 1)
    for i, x in enumerate(ips):
        import ipaddress

        a, b = ipaddress.ip_address(x), ipaddress.ip_address(out[100 + i].entities[0].surrogate)
        assert (a.is_private, a.is_multicast, a.is_link_local) == (b.is_private, b.is_multicast, b.is_link_local) or x == "192.0.2.1"
        assert str(b).split(".")[:2] != x.split(".")[:2] or x.startswith(("192.168", "169.254"))
    t = out[200].surrogate_text
    assert "John" not in t and "Smith " not in t and "Smith'" not in t and "Smithson left" in t and len(out[200].entities) == 3
    first, second, third = (e.surrogate for e in out[200].entities)
    assert first == f"Mr. {second}" and second.endswith(f" {third}")
    a, b = (e.surrogate.split(" ", 1)[1] for e in out[201].entities)
    assert a == b == out[202].entities[0].surrogate.split(" ", 1)[1] and a.split()[0].endswith("na")
    assert out[203].surrogate_text.startswith("Frau Dr. ") and out[203].surrogate_text.endswith(" is here") and "Lena" not in out[203].surrogate_text and "Brien" not in out[203].surrogate_text


def test_odd_tables_of_personal_data(spark, odd):
    assert pii.pseudonymise(odd.limit(0), "k").count() == 0
    clash = spark.createDataFrame([(1, "mail a@b.org", "x", 3), (1, "mail a@b.org", "x", 3)], "doc_id long, text string, entities string, _row int")
    out = pii.pseudonymise(clash, "k").collect()
    assert len(out) == 2 and {(r.entities_in, r._row_in) for r in out} == {("x", 3)} and len({r.surrogate_text for r in out}) == 1
    long = spark.createDataFrame([(1, "word " * 50_000 + "a@b.org")], SCHEMA)
    assert len(pii.pseudonymise(long, "k").first().entities) == 1


# -- toxicity ----------------------------------------------------------------------------------------------------


def test_swapping_group_names_takes_their_weight(spark):
    rows = []
    for i in range(120):
        rows.append((" ".join(text(i, 12).split() + ["muslim"] * (i % 4 != 0) + ["awful"]), 1))
        rows.append((" ".join(text(i + 500, 12).split() + ["christian"] * (i % 4 != 0)), 0))
    df = spark.createDataFrame(rows, "text string, toxic int")
    gap = {}
    for strength in (0.0, 50.0):
        m = toxicity.train(df, strength=strength)
        gap[strength] = abs(m.score("the muslim house", {}) - m.score("the christian house", {}))
        assert m.score("this is awful", {}) > m.score("this is fine", {})
    assert gap[50.0] < 0.5 * gap[0.0]


def test_scores_of_odd_texts_and_single_classes(spark, odd):
    m = toxicity.train(spark.createDataFrame([("a b", 0)], "text string, toxic int"))
    rows = toxicity.score_toxicity(odd, m).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_third(spark):
    from clearbrook.llm.shared import held_out

    df = spark.range(50).withColumn("h", held_out(F.col("id")))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in df.collect())


def test_first_of_each_group_drops_equal_rows(spark):
    rows = [(1, text(1, 80)), (1, text(1, 80)), (2, text(1, 80)), (3, text(2, 80)), (None, None), (None, None), (4, "")]
    out = simhash.first_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "4"]
