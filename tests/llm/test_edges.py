"""Odd tables: nulls, empty and very long texts, repeated rows, empty tables, and extra
columns whose names clash with those that the operators use or add."""

import public_tokenizers
import pytest

import corpus_pipeline
from shockspark.llm import bpe, packing, quality, sharding, simhash, surrogates, syncmers, toxicity, urlfilter
from shockspark.llm import html as pages

LONG = "word " * 60_000 + "x" * 150_000 + " mail a.b@c.example.com " + "y. " * 20_000
ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (6, "It is a text of some words, no more."), (7, "It is a text of some words, no more."),
        (7, "It is a text of some words, no more."), (None, "an id is missing here"), (None, None), (9, "mail a.b@c.example.com and 10.0.0.1")]
CLASH = ["kept", "score", "f", "component_id", "Fingerprint", "slot", "shard", "ids", "mentions", "quality", "row_number", "n_words", "verdict", "k", "v",
         "bucket", "part", "key_order", "a.b", "simhash", "anchors", "next_text", "text_mark", "root", "node", "length"]
MODEL = toxicity.fit(["you idiot", "an idiot", "the moron", "a moron here"] + ["a fine day", "some words here", "no more", "the text"] * 3,
                     [1] * 4 + [0] * 12, 0.25)

OPERATORS = {
    "encode": lambda df: bpe.decode(bpe.encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
                                    public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    "pack": lambda df: packing.pack(df, packing.byte_length()),
    "anchors": lambda df: syncmers.anchors(df, positions="places"),
    "with_next": syncmers.with_next,
    "shards": lambda df: sharding.assign_shards(df, ["a", "b", "c"]),
    "html": lambda df: pages.extract_text(df, url="kept", html="text", key="doc_id", out="main"),
    "urls": lambda df: urlfilter.filter_urls(df, [("net", "/", "block")], url="text"),
    "near_duplicates": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "surrogates": lambda df: surrogates.replace_personal_data(df, "key", counted="n_words"),
    "scores": lambda df: toxicity.scores(df, MODEL),
    "keep_clean": lambda df: toxicity.keep_clean(df, MODEL),
    "quality": quality.quality_rules,
    "keep_quality": quality.keep_quality,
}


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, *CLASH) for i, t in ROWS], schema)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(odd, name):
    out = OPERATORS[name](odd)
    rows = out.collect()
    if name.startswith("keep_"):
        assert out.columns == odd.columns
    elif name == "pack":
        assert sum(r.length for r in rows) == sum(len((t or "").encode()) for _, t in ROWS)
    else:
        assert len(rows) == len(ROWS)
    names = [c.lower() for c in out.columns]
    assert len(set(names)) == len(names)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null(spark, odd, name):
    df = spark.createDataFrame([(None,) * len(odd.columns)] * 3, odd.schema)
    rows = OPERATORS[name](df).collect()
    assert len(rows) == {"keep_one": 1, "keep_quality": 0}.get(name, 3)


def test_values_of_odd_rows(odd):
    ids = {r.doc_id: r for r in OPERATORS["encode"](odd).collect()}
    assert ids[1].ids == [] == ids[2].ids and bytes(ids[1].decoded) == b"" and bytes(ids[5].decoded) == LONG.encode()
    near = simhash.near_duplicates(odd).collect()
    assert {r.component_id for r in near if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in near if r.doc_id in (6, 7)} == {6}
    kept = sorted((r.doc_id or 0 for r in simhash.keep_one(odd).collect()))
    assert kept == [0, 1, 4, 5, 6, 9]
    judged = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    assert judged[1].n_words == 0 and judged[1].base_failed and judged[5].n_words == 80_003 and not judged[5].kept
    changed = {r.doc_id: r for r in surrogates.replace_personal_data(odd, "key", counted="n").collect()}
    assert changed[1].text is None and changed[2].text == "" and changed[9].n == 2 and changed[5].n == 1
    assert changed[5].text.split("mail ")[1].split()[0] == changed[9].text.split()[1] != "a.b@c.example.com"
    marks = {r.doc_id: r for r in syncmers.anchors(odd).collect()}
    assert marks[1].anchors == [] == marks[3].anchors and len(marks[4].anchors) == 1 and marks[6].anchors == marks[7].anchors
    shards = sharding.assign_shards(odd, ["a", "b"]).collect()
    assert len({r.slot for r in shards if r.doc_id is None}) == 1 and all(r.shard for r in shards)


def test_pipeline_over_odd_and_empty_documents(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd.drop("a.b")), ("none", odd.drop("a.b").limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        step = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, step, folder)
            if stage != "packing":
                assert out.columns == step.columns
            out.write.parquet(f"{folder}/{i}")
            step = spark.read.parquet(f"{folder}/{i}")
        if name == "none":
            assert step.count() == 0


def test_pipeline_is_its_stages(spark, tmp_path):
    """The last stage packs exactly what brute force keeps of sf0.001."""
    from test_operators import SF0001, brute_components, brute_quality, brute_simhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    good = {d for d, t in docs.items() if brute_quality(t)[-1]}
    table = spark.read.parquet(f"{SF0001}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stage["quality_rules"](spark, table, SF0001).collect()} == good
    kept = table.filter(table.doc_id.isin([int(d) for d in good]))
    model = toxicity.train(kept, spark.read.parquet(f"{SF0001}/labels.parquet"))
    clean = sorted(d for d in good if model.score(docs[d]) < 0.5)
    roots = brute_components([brute_simhash(docs[d]) for d in clean], 2)
    first = {}
    for d, r in zip(clean, roots):
        first.setdefault(r, d)
    rows = corpus_pipeline.run(spark, SF0001).collect()
    assert {r.doc_id for r in rows} == set(first.values())
    unchanged = [d for d in first.values() if "@" not in docs[d] and not any(c.isdigit() for c in docs[d])]
    size = {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert all(size[d] == len(docs[d].encode()) for d in unchanged)


AWKWARD = {
    "two spellings of one capital form": "Herr Groß und Herr Gross, Herr Strauß, Frau Strauss. STRAUSS! Groß? Gross.",
    "short capital names": "Mr LU and Ms LI met Mr LO, Mrs LA, Mr LE, Ms Li, Mr Lu. LU, LI!",
    "letters in a row": "Mr Smith sent " + "ACGT" * 100_000 + ". Mary A" + "b" * 100_000 + " Dr " + "X" * 250_000 + " Mr O'" + "O'" * 50_000 + "Brien-" + "Aa-" * 50_000,
    "astral letters": "mail 𝒂𝒃@b.com and 😀😀 Frau 𝒂, call 555-123-4567 😀",
    "other alphabets": "Herr Šimič, Mr Nguyễn, mail wang@公司.cn and Иван Ёлкин or юля@почта.рф",
}


def test_awkward_texts_keep_the_job_alive(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD.values())], "doc_id long, text string")
    got = dict(zip(AWKWARD, (r.text for r in sorted(surrogates.replace_personal_data(df, "key").collect()))))
    first = got["two spellings of one capital form"]
    names = [w.strip(",.!?") for w in first.split()]
    assert not {"Groß", "Gross", "Strauß", "Strauss", "STRAUSS"} & set(names)
    assert names[1] != names[4] and names[1] == names[-2] and names[4] == names[-1]  # each spelling its own, bare too
    assert names[-3] == names[-3].upper() and names[-3].lower() in (names[6].lower(), names[8].lower())
    short = [w.strip(",.!") for w in got["short capital names"].split()]
    assert short[1] == short[-2] == short[1].upper() and short[4] == short[-1] and not {"LU", "LI", "LO", "LA", "LE"} & set(short)
    assert "ACGT" * 100_000 in got["letters in a row"] and "Smith" not in got["letters in a row"]
    assert "?" not in got["astral letters"] and "𝒂𝒃" not in got["astral letters"] and ".com and" in got["astral letters"] and got["astral letters"].endswith(" 😀") and "😀😀" in got["astral letters"]
    other = got["other alphabets"]
    assert not any(c in other for c in ("Šim", "mič", "Nguy", "ễn", "公", "司", "Ёлк", "юля", "почта")) and ".cn" in other


def test_awkward_texts_pass_the_pipeline_stage(spark, tmp_path):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(AWKWARD.values())], "doc_id long, text string, source int")
    out = dict(corpus_pipeline.STAGES)["pii"](spark, df, str(tmp_path))
    assert out.columns == df.columns and out.count() == len(AWKWARD)
