import numpy as np
import pytest

from geoloom.llm import encoding, packing

SCHEMA = "doc_id bigint, text string, lang string, size string, container string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash") for i, t, lang in rows], SCHEMA)


def specs(spark, rows):
    return spark.createDataFrame(rows, "spec_id int, capacity_tokens int, per_field string")


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 300):
        sizes = sorted(rng.integers(0, 100, n).tolist(), reverse=True)
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= s
            want.append(k)
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_everything_is_packed_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 120))), ["en", "de", None][i % 3]) for i in range(300)] + [(900, None, "en"), (901, "", None), (902, "long " * 9000, "de"), (5, "again again", None)]
    got = packing.pack(docs(spark, rows), specs(spark, [(1, 64, None), (2, 256, "lang")]), group=100).toPandas()
    bpe = encoding.load(encoding.vocabulary_file())
    want = sum(len(bpe.encode(t)) for _, t, _ in rows)
    lang = {i: v for i, _, v in rows}
    for spec, cap in ((1, 64), (2, 256)):
        g = got[got.spec_id == spec]
        assert g["size"].sum() == want and g.groupby("container")["size"].sum().max() <= cap
        assert set(g.doc_id) == {i for i, _, _ in rows}
        pieces = g[g.doc_id == 902].sort_values("piece")
        assert pieces.piece.tolist() == list(range(len(pieces))) and (pieces["size"].iloc[:-1] == cap).all()
        whole = g[g.doc_id < 900].groupby("doc_id").size()
        assert all(n == 1 for i, n in whole.items() if i != 5 and len(bpe.encode(rows[i][1])) <= cap)
        assert g["size"].sum() / (g.container.nunique() * cap) > 0.9
    assert got[got.spec_id == 2].groupby("container").doc_id.agg(lambda v: len({lang[i] for i in v})).max() == 1


def test_refusals_and_empty_tables(spark):
    some = docs(spark, [(1, "a", "en")])
    with pytest.raises(ValueError):
        packing.pack(some, specs(spark, [(1, 8, "nowhere")]))
    with pytest.raises(ValueError):
        packing.pack(some, specs(spark, [(1, 0, None)]))
    assert packing.pack(docs(spark, []), specs(spark, [(1, 8, None), (2, 8, "lang")])).count() == 0
    assert packing.pack(some, specs(spark, [])).count() == 0
