"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from prefloom.llm import lines, mixing, quality
from prefloom.llm.common import documents, stored
from tests.llm.helpers import SMALL, no_documents, odd_documents
from tests.llm.test_lines import distance
from tests.llm.test_quality import brute as base_counts
from tests.llm.test_simhash import brute_mark
from tests.llm.test_tokens_and_packing import check_packing


@pytest.fixture(scope="module")
def staged(spark):
    found = [documents(spark, SMALL)]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stored(spark, stage(spark, found[-1], SMALL)))
    return found


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_keep_the_columns(staged):
    assert all(frame.columns == staged[0].columns for frame in staged[:5])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "mix", "pack"]


def test_quality_stage(spark, staged):
    before, after = rows(staged[0]), rows(staged[1])
    labels = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    # At this size no stratum has labels enough for a cutoff: the base rules decide.
    assert max(Counter(before[i].lang for i in labels).values()) * len(quality.RULES) < 2000
    assert set(after) == {i for i, r in before.items() if not base_counts(r.text or "")[-1]}
    assert all(after[i] == before[i] for i in after)


def test_line_stage(staged):
    before, after = rows(staged[1]), rows(staged[2])
    seen, root, order = [], {}, []
    for doc_id in sorted(before):
        for at, line in enumerate((before[doc_id].text or "").split("\n")):
            line = line.strip(lines.WHITE)
            if len(line) >= lines.MIN_CHARS:
                order.append((doc_id, at, line))
    for _, _, line in order:
        if line not in root:
            root[line] = line
            near = [x for x in seen if abs(len(x) - len(line)) <= 2 and distance(x, line, 2) <= 2]
            seen.append(line)
            for other in near:
                a, b = find(root, other), find(root, line)
                root[b] = a
    # Shorter lines are alike only if equal.
    order = [
        (doc_id, at, line.strip(lines.WHITE))
        for doc_id in sorted(before)
        for at, line in enumerate((before[doc_id].text or "").split("\n"))
        if line.strip(lines.WHITE)
    ]
    first, gone = set(), defaultdict(set)
    for doc_id, at, line in order:
        key = find(root, line) if line in root else line
        if key in first:
            gone[doc_id].add(at)
        first.add(key)
    assert sum(map(len, gone.values())) > 20 and set(after) == set(before)
    for doc_id, row in before.items():
        kept = [x for at, x in enumerate(row.text.split("\n")) if at not in gone[doc_id]]
        assert after[doc_id].text == "\n".join(kept)


def find(root, line):
    while root[line] != line:
        line = root[line]
    return line


def test_near_dedup_stage(staged):
    before, after = rows(staged[2]), rows(staged[3])
    ids = sorted(before)
    marks = {i: brute_mark(before[i].text) for i in ids}
    root = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = find(root, a), find(root, b)
                root[max(x, y)] = min(x, y)
    assert sorted(after) == sorted({find(root, i) for i in ids}) and len(after) < len(before)


def test_mix_and_pack_stages(staged):
    taken = {r.doc_id: r.taken for r in mixing.taken_words(staged[3]).collect()}
    words = Counter()
    for r in staged[4].collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert words == Counter({i: n for i, n in taken.items() if n})
    found = defaultdict(list)
    for r in staged[4].collect():
        found[r.doc_id].append(r.text)
    check_packing(staged[5].collect(), [(i, t) for i, texts in found.items() for t in texts])


def test_pack_stage_keeps_the_ids(staged):
    for r in staged[5].collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_run_and_registration(spark, staged):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.drop("sequence_id", "step_id", "offset").collect())) == sorted(
        map(tuple, staged[5].drop("sequence_id", "step_id", "offset").collect())
    )
    named = entry_module.queries()
    assert named["pipeline"] is corpus_pipeline.run and all(any(n.startswith(f"op{i}_") for n in named) for i in range(1, 11))


def test_helper_columns_never_clash(spark):
    names = ["_doc", "doc", "tie", "_tie", "_one", "gone", "_gone", "copy", "_copy", "k", "d", "Doc_"]
    docs = documents(spark, SMALL).where("doc_id % 5 = 0")
    docs = docs.selectExpr("*", *[f"{n} * 10 + doc_id AS `{name}`" for n, name in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(spark, stage(spark, docs, SMALL))
        for row in docs.collect():
            assert all(row[name] == n * 10 + row.doc_id for n, name in enumerate(names))
    assert docs.count() > 0


def test_stages_take_odd_and_empty_tables(spark):
    for frame in (odd_documents(spark), no_documents(spark)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(spark, stage(spark, docs, SMALL))
        assert "sequence_id" in docs.columns
