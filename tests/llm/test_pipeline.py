"""The pipeline's stages, one after another, against plain versions of each."""

import public_tokenizers
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from msgwarden.llm import quality
from msgwarden.llm import repeats as r
from tests.llm.test_packing import check
from tests.llm.test_repeats import Counter, np
from tests.llm.test_simhash import plain_fingerprint, plain_groups


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows, tables = [tuple(x) for x in docs.collect()], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs)
    assert all(t.columns == columns for t in tables[:-1])

    pack = zstandard.ZstdCompressor(level=quality.LEVEL)
    rows = [x for x in rows if x[1] is not None and quality.measure(x[1], pack)[6]]
    assert sorted(map(tuple, tables[0].collect())) == sorted(rows)

    groups = plain_groups([x[0] for x in rows], [plain_fingerprint(x[1]) for x in rows])
    rows = [x for x, g in zip(rows, groups) if x[0] == g]
    assert sorted(map(tuple, tables[1].collect())) == sorted(rows)

    raws = [x[1].encode() for x in rows]
    seen = Counter(b[i : i + r.LENGTH] for b in raws for i in range(len(b) - r.LENGTH + 1))
    left = []
    for x, b in zip(rows, raws):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - r.LENGTH + 1):
            if seen[b[i : i + r.LENGTH]] > 1:
                gone[i] += 1
                gone[i + r.LENGTH] -= 1
        gone, text, at = np.cumsum(gone) > 0, [], 0
        for c in x[1]:
            size = len(c.encode())
            text += [] if gone[at : at + size].any() else [c]
            at += size
        text = "".join(text)
        left.append((x[0], text, *x[2:4], len(text)))
    assert sorted(map(tuple, tables[2].collect())) == sorted(left)

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = lambda text: found.encode(text, add_special_tokens=False).ids + [1]
    check(tables[3].collect(), [(x[0], x[1]) for x in left], plain)
    again = sorted((x.doc_id, x.start, x.length, x.ids_crc32) for x in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())
    assert sum(x[2] for x in again) == sum(len(plain(x[1])) for x in left)


def test_awkward_rows(spark, sf_dir):
    prose = " ".join(f"word{i * 37 % 101}x{i}" for i in range(60))
    rows = [(1, None, "en", "s", 0, 1), (2, "", None, None, None, 2), (None, prose, "en", "s", 9, 3), (4, prose, "en", "s", 9, 4), (4, prose, "en", "s", 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, place int")
    for frame, kept in ((docs, [4]), (docs.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf_dir)
            assert frame.columns == docs.columns, name
        assert [x.doc_id for x in frame.collect()] == kept
        packed = corpus_pipeline.packing(spark, frame, sf_dir).collect()
        assert {x.doc_id for x in packed} == set(kept)
