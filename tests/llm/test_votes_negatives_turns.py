"""Quality votes, hard negatives and conversation repair: brute force, odd rows, held-out accuracy."""

import hashlib
import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest

from meterlake.llm import entry, negatives, quality, turnrepair, turnrepair_sql
from tests.conftest import DATA, rows_of

TURNS = "conv_id long, turn long, role string, text string, kind string, kinds string, said_of string, copy int"


def conversations(spark, rows):
    """Conversations with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], TURNS)


def by_sql(statement, **tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame)
    return c.execute(statement).df()


def cheapest(kinds):
    """All label strings of at most three inserts, tried out."""
    best = None
    for inserts in range(4):
        for sites in itertools.combinations_with_replacement(range(len(kinds) + 1), inserts):
            for edits in itertools.product("DKR", repeat=len(kinds)):
                labels = "".join("I" * sites.count(k) + (edits[k] if k < len(kinds) else "") for k in range(len(kinds) + 1))
                said, cost, row, ok = [], 0, 0, True
                for label in labels:
                    if label == "I":
                        said.append("?")
                        cost += 5
                        continue
                    initial, fault = kinds[row]
                    row += 1
                    if label == "D":
                        cost += 2
                    else:
                        ok &= fault not in ("blank", "duplicate")
                        said.append(initial if label == "K" else "?")
                        cost += (label == "R") + 5 * (fault == "truncated")
                whole = "".join(said)
                for head in ("", "s"):
                    body = whole[len(head) :]
                    fits = whole.startswith(head) and len(body) % 2 == 0 and all(c in ("?", "ua"[k % 2]) for k, c in enumerate(body)) and (not head or body)
                    if ok and fits and (best is None or (cost, labels) < best):
                        best = (cost, labels)
    return best


def test_shortest_path_is_the_least_of_all():
    rng = np.random.default_rng(5)
    for _ in range(400):
        kinds = [(str(rng.choice(list("suuaat"))), str(rng.choice(["", "", "", "blank", "duplicate", "truncated"]))) for _ in range(rng.integers(0, 5))]
        assert turnrepair.shortest_path(kinds) == cheapest(kinds), kinds


def odd_turns(n=60):
    rng = np.random.default_rng(1)
    texts = [None, "", " \t", "Yes.", "Yes", "No! ", "é?", "a.b", "word " * 50, "Ends.\x0b", "Ends "]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "Ünder"]
    rows = []
    for c in [None, *range(n)]:
        for t in range(rng.integers(1, 7)):
            turn = None if rng.random() < 0.1 else int(t + 3 * (rng.random() < 0.1)) * (1 if rng.random() < 0.95 else -1)
            rows.append((c, turn, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("held", [turnrepair.HELD_CHARS, 40])
def test_odd_conversations_by_sql(spark, held):
    rows = odd_turns()
    got = turnrepair.repaired(conversations(spark, rows), held_chars=held).toPandas()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert rows_of(got) == rows_of(by_sql(turnrepair_sql.REPAIR, conversations=frame))
    assert len(got) == 61 and got.repaired_sha256.notna().all()


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(30_000)]
    one = turnrepair.repaired(conversations(spark, rows), held_chars=1000).toPandas()
    two = turnrepair.repaired(conversations(spark, rows)).toPandas()
    assert rows_of(one) == rows_of(two) and len(one.audit[0]) > 27_000 and one.gaps[0] > 1000
    assert turnrepair.repaired(conversations(spark, rows).limit(0)).count() == 0


def test_conversation_whose_rows_are_all_dropped(spark):
    import zlib

    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = turnrepair.repaired(conversations(spark, [(gone, 0, "user", "Hi.")])).first()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


VECTORS = "vec_id long, embedding array<float>, label int, uid long, scores array<long>, shard int, list string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, [2], 3, "x") for r in rows], VECTORS)


def odd_vectors(n=700):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 12))
    rows = []
    for k in range(n):
        x = (centres[rng.integers(4)] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist()
        rows.append((k, x, int(rng.integers(-2, 11))))
    rows += [(k, rows[3][1], k % 4) for k in range(1000, 1300)] + rows[100:104] * 3  # one very common vector, rows that repeat
    rows += [(None, rows[5][1], 1), (None, rows[5][1], 2), (2000, None, 1), (2100, [None] * 12, 1), (2200, [float("nan")] * 12, 1), (2300, [float("inf")] * 12, 2), (2400, [1e30] * 12, 1), (2500, rows[7][1], None)]
    return rows + [(3000, [], 1), (3001, [], 1), (3100, [], 2), (3200, [1.0, 2.0], 4), (3201, [1.0, 2.0], 4), (3202, [1.0, 1.75], 5), (3300, [0.0] * 12, 1), (3400, [-0.5] * 12, 3)]


@pytest.mark.parametrize("shard_rows, block", [(16_384, 1024), (150, 64)])
def test_negatives_of_odd_vectors_by_sql(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    rows = odd_vectors()
    got = negatives.hard_negatives(vectors(spark, rows)).toPandas()
    held = [r for r in rows if r[0] != 2400]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in held])
    want = c.execute(negatives.NEGATIVES_SQL).df()
    assert len(got) > 100 and rows_of(got.astype({"negative_id": "Int64", "positive_id": "Int64"})) == rows_of(want.astype({"negative_id": "Int64", "positive_id": "Int64"}))


def test_negatives_of_an_empty_table_and_of_great_ids(spark):
    assert negatives.hard_negatives(vectors(spark, odd_vectors(5)).limit(0)).count() == 0
    top = 2**62 - 2**62 % 700 - 300  # divisible by 100, neither it nor the next three by 7
    rows = [(top, [1.0, 0.0], 1), (top + 1, [1.0, 0.0], 1), (top + 3, [0.9, 0.1], 2), (None, [0.9, 0.1], 2)]
    got = negatives.hard_negatives(vectors(spark, rows)).orderBy("rank").collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in got if r.anchor_id == top][0] == (top, top + 1, top + 3) and got[-1].negative_id is None


def test_leading_components_discard_most_pairs():
    rng = np.random.default_rng(3)
    low_rank = (rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 64)) * 20 + rng.normal(size=(3000, 64))).round()
    frame = pd.DataFrame({"uid": range(3000), "id": range(3000), "none": False, "label": 1, "vector": list(low_rank.astype(np.int64))})
    rotation = np.linalg.eigh(low_rank.T @ low_rank)[1][:, ::-1]
    rows, anchors = negatives.Rows(frame, rotation, 64), negatives.Rows(frame[:50], rotation, 64)
    low = np.sort(low_rank[:50] @ low_rank.T, axis=1)[:, -10]
    found = [x for x in negatives.survivors(anchors, rows, slice(0, 3000), np.ones((50, 3000), bool), low, np.full(50, np.inf))]
    assert sum(len(q) for q, _, _ in found) == (low_rank[:50] @ low_rank.T >= low[:, None]).sum()
    assert all((score == (low_rank[q] * low_rank[x]).sum(axis=1)).all() for q, x, score in found)


DOCS = "doc_id long, text string, lang string, source string, score double, predicted int, term int, label int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0.5, 3, 4, 5) for i, t in rows], DOCS)


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def made_texts(n=400):
    """Good prose and three kinds of junk by another maker than the test tables'."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeilmnorstu"), rng.integers(2, 9))) for _ in range(500)]
    rows = []
    for k in range(n):
        some = list(rng.choice(words, rng.integers(30, 200)))
        kind = k % 8
        text = " ".join(w + ("." if j % 9 == 8 else "") for j, w in enumerate(some)).capitalize()
        if kind == 1:
            text = " ".join(f"{w.upper()}!?" for w in some)
        elif kind == 2:
            text = " ".join([some[0]] * 40 + some[:5])
        elif kind == 3:
            text = " <> ".join(f"{w}~" for w in some)
        rows.append((k, text, int(kind not in (1, 2, 3))))
    return rows


def test_held_out_accuracy_and_no_leak(spark):
    rows = made_texts()
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    got = quality.scores(docs, marks(spark, [(i, q, 0) for i, _, q in rows])).toPandas().set_index("doc_id")
    held = [(i, q) for i, _, q in rows if got.held_out[i]]
    assert len(held) > 50 and np.mean([got.predicted[i] == q for i, q in held]) > 0.97 and got.score.between(0, 1).all()
    turned = quality.scores(docs, marks(spark, [(i, 1 - q if got.held_out[i] else q, 1) for i, _, q in rows])).toPandas().set_index("doc_id")
    assert (turned.score == got.score).all()


def test_held_out_accuracy_on_the_tables(spark):
    got = entry.op11_quality_votes(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


def test_odd_documents_are_scored(spark):
    rows = [(i, t) for i, t, _ in made_texts(80)] + [(900, None), (901, ""), (902, " \t\n"), (903, "x"), (903, "x"), (None, "y z."), (904, "w " * 200_000), (0, "another text of this id.")]
    labels = marks(spark, [(i, q, 0) for i, _, q in made_texts(80)] + [(0, 1, 0), (0, 0, 0), (None, 1, 0), (5, None, 0), (900, 1, 0), (7777, 0, 0)])
    got = quality.scores(documents(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    blank = got[got.doc_id.isin([900, 901, 902])].score
    assert blank.nunique() == 1 and (got[got.doc_id == 903].score.nunique() == 1)
    assert list(quality.scores(documents(spark, rows), labels.limit(0)).select("score").distinct().toPandas().score) == [0.5]
    assert quality.scores(documents(spark, rows).limit(0), labels).count() == 0
    assert set(quality.scores(documents(spark, rows[:3]), marks(spark, [(i, 1, 0) for i in range(9)])).toPandas().score) == {1.0}


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(6)
    matrix, labels, weights = rng.random((60, quality.TERMS), dtype=np.float32), rng.integers(0, 2, 60).astype(float), rng.random(60)
    votes = quality.Votes(matrix, labels, weights, np.ones(quality.TERMS))
    asked = rng.random((5, quality.TERMS), dtype=np.float32)
    for x, got in zip(asked, votes.score(asked)):
        y = (x * votes.scale) @ votes.base
        cosines = [float(y @ v / np.linalg.norm(y)) for v in votes.vectors]
        near = sorted(range(60), key=lambda k: -cosines[k])[: quality.NEIGHBOURS]
        mass = [max(cosines[k], 0) ** quality.POWER * weights[k] for k in near]
        assert got == pytest.approx(sum(m * labels[k] for m, k in zip(mass, near)) / sum(mass), abs=1e-4)


def test_shapes_and_gaps():
    assert [quality.shape_of(w) for w in ("DE!!", "Der", "der.", "a", "A|", "x7-9", "iPad")] == ["U!!", "T", "l.", "T", "U|", "l0-", "m"]
    terms, shares = quality.term_shares("a a a a", quality.Codes())
    assert {int(t) - quality.WORD_TERMS - quality.SHAPE_TERMS: round(float(s) ** 2, 2) for t, s in zip(terms, shares) if t >= quality.WORD_TERMS + quality.SHAPE_TERMS} == {0: 0.25, 1: 0.75}
