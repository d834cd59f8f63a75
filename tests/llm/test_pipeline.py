"""The pipeline against a brute-force version, stage by stage and as a whole."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_operators import LANGS, ODD, _components, _targets, bpe

import corpus_pipeline
from tidelog.llm import language, secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        lang = rng.choice(list(LANGS))
        text = " ".join(rng.choices(LANGS[lang].split(), k=rng.randint(20, 60)))
        if i % 10 == 3:
            text += " password=hunter22 and more"
        if i % 7 == 5:
            text = rows[-1][1] + " end"
        rows.append((i, text, lang, f"src{rng.choice([0, 0, 0, 1, 2])}"))
    rows += [(2000 + i, "".join(rng.choices("bcdfghjklmnpqrstvwxz ", k=300)), None, "src1") for i in range(3)]
    return rows + [(i and i + 1000, t, lang, s) for i, t, lang, s in ODD]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    frame(spark, rows).write.parquet(f"{root}/documents.parquet")
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {"input": rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != "pack":
            assert out.columns == docs.columns
            out.write.parquet(f"{root}/{name}.parquet")
            docs = spark.read.parquet(f"{root}/{name}.parquet")
            seen[name] = as_rows(docs)
        else:
            seen[name] = out.collect()
    seen["run"] = corpus_pipeline.run(spark, root).collect()
    return seen


def test_language_drops_what_is_like_no_language(spark, stages):
    """By the machines of the same labels, a text at a time; texts of words stay, runs of consonants and texts without a letter go."""
    m = language.fit(frame(spark, stages["input"]).where(~language.held_out()).select("text", "lang"))

    def stays(text):
        if not text or not any(c.isalpha() for c in text):
            return False
        return m.judge([text.encode()])[0][3] >= 1.2

    assert sorted(stages["language"], key=str) == sorted([r for r in stages["input"] if stays(r[1])], key=str)
    kept = {r[0] for r in stages["language"]}
    assert set(range(150)) <= kept and 2001 not in kept


def test_one_of_each_component_stays(stages):
    rows = stages["language"]
    with_id = list({r[0]: r for r in rows if r[0] is not None}.values())
    comp = _components(with_id)
    want = [r for r in with_id if comp[r[0]][1] == r[0]] + [r for r in rows if r[0] is None]
    assert sorted(stages["jaccard"], key=str) == sorted(want, key=str)
    assert len(stages["jaccard"]) < len(rows)


def test_secrets_are_masked(stages):
    want = [(i, secrets.redact_text(t), lang, s) for i, t, lang, s in stages["jaccard"]]
    assert sorted(stages["secrets"], key=str) == sorted(want, key=str)
    assert any("[secret]" in t for _, t, _, _ in want) and not any("hunter22" in t for _, t, _, _ in stages["secrets"])


def test_mix_takes_whole_documents_near_the_targets(stages):
    sizes, taken, known = {}, {}, {r: 0 for r in stages["secrets"]}
    for _, t, _, s in stages["secrets"]:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in stages["mix"]:
        known[r] += 1
        taken[r[3]] = taken.get(r[3], 0) + len(r[1].split())
    assert max(known.values()) <= 2
    want = _targets(sizes)
    longest = {s: max(len(t.split()) for _, t, _, x in stages["secrets"] if x == s) for s in sizes}
    assert all(want[s] - longest[s] - 1 <= taken.get(s, 0) <= want[s] + 1 for s in sizes)


def test_pack_holds_every_token_once(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe())
    want = sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t, _, _ in stages["mix"])
    assert sum(r["length"] for r in stages["pack"]) == want
    fill = {}
    for r in stages["pack"]:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-want // 1024) + 1
    strip = lambda rows: sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert strip(stages["pack"]) == strip(stages["run"])


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), "").count() == 0, name


def test_redaction_sets_lengths(spark):
    out = corpus_pipeline.stage_secrets(spark, frame(spark, [(1, "a secret=abcdefgh", "en", "s"), (2, None, None, None)]), "")
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()} == {1: len("a [secret]"), 2: 0}
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py" and F is not None


def test_language_keeps_lettered_texts_without_labels(spark):
    rows = [(1, "some words", None, "s"), (2, "12 34", None, "s"), (3, None, None, "s"), (4, "漢字", None, "s")]
    assert sorted(r[0] for r in as_rows(corpus_pipeline.stage_language(spark, frame(spark, rows), ""))) == [1, 4]
