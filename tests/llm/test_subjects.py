import random

from geoloom.llm import subjects as S

DOCS = "doc_id bigint, title string, text string, subject string"
WORDS = {"music": ["violin", "chorus", "guitar", "melody", "amplifier"], "law": ["court", "lawyer", "contract", "appeal", "verdict"], "cooking": ["oven", "recipe", "dough", "sauce", "pan"]}
IDLE = ["The box was dented.", "Bought it for my brother.", "Delivery took 4 days.", "It is okay for the price.", "My sister keeps it on the balcony."]


def corpus(n, seed):
    rng, docs, truth = random.Random(seed), [], {}
    for i in range(n):
        own = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 2]))
        lines = [f"We tried the {rng.choice(WORDS[s])} beside the {rng.choice(WORDS[s])} on day {rng.randint(1, 99)}." for s in own for _ in range(rng.randint(1, 3))]
        lines += rng.sample(IDLE, 3)
        rng.shuffle(lines)
        docs.append((i, "Great", " ".join(lines), "clash"))
        truth[i] = set(own)
    return docs, truth


def run(spark, docs, labels, covers=True):
    d = spark.createDataFrame(docs, DOCS)
    s = spark.createDataFrame([(k, " ".join(v) if covers else None) for k, v in WORDS.items()], "subject string, covers string")
    got = {}
    for r in S.assign_subjects(d, s, spark.createDataFrame(labels, "doc_id bigint, subject string")).collect():
        assert r["subject"] not in got.setdefault(r["doc_id"], set())
        got[r["doc_id"]].add(r["subject"])
    return got


def test_held_out_documents(spark):
    docs, truth = corpus(900, 3)
    rng = random.Random(4)
    labels = []
    for i in range(300):
        for s in truth[i] or {"none"}:
            labels.append((i, s if rng.random() > 0.1 else rng.choice(sorted(WORDS))))  # some are wrong
    docs += [(900, None, None, None), (901, "", " ", None), (902, docs[5][1], docs[5][2], None), (903, None, (docs[7][2] + " ") * 300, None), (904, docs[8][2], "", None)]
    got = run(spark, docs, labels)
    tp = sum(len(got.get(i, set()) & truth[i]) for i in range(300, 900))
    assert tp / sum(len(got.get(i, set())) for i in range(300, 900)) > 0.9 and tp / sum(len(truth[i]) for i in range(300, 900)) > 0.9
    assert 900 not in got and 901 not in got
    assert got.get(902) == got.get(5) and got.get(903) == got.get(7) and got.get(904) == got.get(8)


def test_without_labels_or_documents(spark):
    assert run(spark, [], []) == {}
    docs, _ = corpus(20, 1)
    assert isinstance(run(spark, docs, []), dict)
    assert isinstance(run(spark, docs, [(None, "law"), (1, None), (77, "law")], covers=False), dict)


def test_texts_are_read_alike():
    assert S.plain("<b>Café</b> 42&nbsp;façade").split() == S.plain("cafe 17 facade").split() == ["cafe", "0", "facade"]
    assert list(S.segments("One two. Three! 三。四")) == ["one two.", "three!", "三。", "四"]
    long = " ".join(f"w{i}" for i in range(60))
    assert all(len(s.split()) <= S.WINDOW for s in S.segments(long)) and {w for s in S.segments(long) for w in s.split()} == {"w0"}
    assert S.repaired("MÃ¼nchen") == "München" and S.repaired("München") == "München"
    assert list(S.segments(None)) == [] and S.terms("").tolist() == []


def test_otsu_parts_two_groups():
    import numpy as np

    h = np.zeros(100)
    h[10:15], h[60:70] = 50, 10
    assert 14 <= S.otsu(h) < 60 and S.otsu(np.zeros(5)) == 0


def test_partial_sums_are_added_in_bounded_groups(spark):
    import numpy as np

    def ones(batches):
        total = np.zeros((3, 2))
        for b in batches:
            total += b.num_rows
        yield from S._partial(total)

    got = S._slabs(spark.range(1000).repartition(70), ones, 3, 2)
    assert got.shape == (3, 2) and (got == 1000).all()
