"""The stages of the corpus pipeline against brute force, on small tables with odd rows and clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clearbrook.llm import decontaminate, pii, simhash, toxicity

SYLLABLES = "ka lo mi ne ru ta vi so pe du".split()
EXTRA = "group_id long, score double, items string, entities string, predicted int, surrogate_text string, repeated boolean, keep boolean"


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, text(i, 120), "aa") for i in range(150)]
    rows = [(i, t + " filthy vermin scum" * 3 if i % 5 == 0 else t, x) for i, t, x in rows]
    base = text(7, 120).split()
    rows += [(200, text(7, 120), "aa"), (201, " ".join([*base[:60], "changed", *base[61:]]), "aa"), (202, " ".join([*base, *text(900, 12).split()]), "aa"), (203, text(3, 120), None), (203, text(3, 120), None)]
    rows += [(210, text(901, 40) + " " + text(500, 30) + " " + text(902, 40), "aa"), (211, "Mr. John Smith, a.b@site.org, 10.1.2.3 " + text(903, 60), "aa")]
    rows += [(220, None, None), (221, "", "aa"), (222, " \n ", "aa"), (None, text(904, 30), "aa"), (223, "long " * 30_000, "aa")]
    docs = spark.createDataFrame([(i, t, x, "src", None if t is None else len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = [F.lit(k + 1).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for k, f in enumerate(EXTRA.split(", "))]
    docs.select("*", *clash).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, text(500, 30)), (2, text(501, 30)), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["toxicity"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    model = toxicity.model_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept(out) == Counter(dict(kept(docs).items())) - Counter({k: n for k, n in kept(docs).items() if model.score(k[1], {}) >= 0.7})
    assert not any("vermin" in (t or "") for _, t in kept(out)) and len(kept(out)) > 100

    before = sorted(kept(docs).elements(), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    want = Counter(before[min(i for i, h in enumerate(group) if h == g)] for g in set(group))
    out = stages["near duplicates"](spark, docs, sf_dir)
    assert out.columns == docs.columns and Counter(i for i, _ in kept(out).elements()) == Counter(i for i, _ in want.elements())
    assert {r.group_id for r in out.collect()} == {1}

    out = stages["decontamination"](spark, docs, sf_dir)
    items = [decontaminate.item_shingles(decontaminate.words_of(text(500 + k, 30)))[1] for k in (0, 1)]
    held = lambda t: any(decontaminate.contained(s, decontaminate.windows_of(decontaminate.words_of(t), 5), 0.8) is not None for s in items)
    assert out.columns == docs.columns and kept(out) == Counter({k: n for k, n in kept(docs).items() if not held(k[1])}) and kept(docs)[(210, text(901, 40) + " " + text(500, 30) + " " + text(902, 40))]

    out = {r.doc_id: r for r in stages["personal data"](spark, docs, sf_dir).collect()}
    assert not any(x in out[211].text for x in ("John", "Smith", "a.b@site", "10.1.2.3")) and out[211].text.endswith(text(903, 60)) and out[211].n_chars == len(out[211].text)
    assert all(out[i].text == t for i, t in kept(docs) if i != 211) and out[220].text is None and out[1].entities == "4"

    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages["sentencepiece"](spark, docs, sf_dir).collect():
        assert r.n_tokens == len(library.encode(r.text or ""))


def test_stages_in_turn_and_on_an_empty_table(spark, sf_dir, tmp_path):
    spark.conf.set(pii.KEY_SETTING, "test")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and 210 not in ids and 201 not in ids and 211 in ids and not any(i is not None and i < 150 and i % 5 == 0 for i in ids)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
