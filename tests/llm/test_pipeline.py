"""Each stage of the pipeline against a plain version, on the stage's own input."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from helixframe.llm import quality
from helixframe.llm.common import materialize, table
from helixframe.llm.queries import tokenizer_path
from tests.llm.plain import jaccard_components, plain_contaminated, plain_posteriors, plain_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in P.STAGES:
        after = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs, after, docs.collect(), after.collect()
        docs = after
    return out


def test_stages_in_order(spark, stages):
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    columns = table(spark, SF, "documents").columns
    assert all(after.columns == columns for name, (_, after, _, _) in stages.items() if name != "tokens")
    assert len({len(before) for _, _, before, _ in stages.values()}) > 3


def test_quality(spark, stages):
    docs, _, before, after = stages["quality"]
    model = quality.fit(docs, table(spark, SF, "labels"))
    chance = [float(model.chances([(r["text"] or "").encode()])[0]) for r in before]
    scores = plain_posteriors([(r["source"], r["lang"]) for r in before], chance)
    assert not any(abs(s - 0.5) < 1e-6 for s in scores)
    assert Counter(after) == Counter(r for r, s in zip(before, scores, strict=True) if s >= 0.5)


def test_near_dedup(stages):
    _, _, before, after = stages["near_dedup"]
    _, comps = jaccard_components([(r["doc_id"], r["text"]) for r in before], 5)
    assert Counter(after) == Counter(r for r in before if comps[r["doc_id"]] == r["doc_id"])


def test_decontaminate(spark, stages):
    _, _, before, after = stages["decontaminate"]
    bad = plain_contaminated([r["text"] for r in before], [r["text"] for r in table(spark, SF, "benchmark").collect()])
    assert Counter(after) == Counter(r for r, b in zip(before, bad, strict=True) if not b)


def test_mix(stages):
    _, _, before, after = stages["mix"]
    size = {r: len((r["text"] or "").encode().split()) for r in before}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size[r]
        largest[r["source"]] = max(largest[r["source"]], size[r])
    for r in after:
        taken[r["source"]] += size[r]
    targets = plain_targets(list(sizes.items()))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source], source
    copies = Counter(after)
    for r in before:
        expected = targets[r["source"]] / sizes[r["source"]]
        assert int(expected) <= copies[r] <= min(2, int(expected) + 1)


def test_tokens(stages):
    _, _, before, after = stages["tokens"]
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in before:
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == want


def test_run(spark):
    out = P.run(spark, SF).orderBy("start").collect()
    assert out[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
