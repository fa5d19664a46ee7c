"""The transducers against the model's own library, and round trips."""

import random

import pytest

from turnloom.llm import pieces as pc

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.MODEL)


def texts():
    rng = random.Random(1)
    letters = " ▁ \n\tabcdefghijklmnopqrstuvwxyzABCÉé漢字ßñ1234567890.,;:!?<>#@-_/'\"()😀の벨"
    parts = ["the", "ing", " ", "  ", "er", "an", "def ", "  return", "self", ".", "(", ")", "\n", "    ", "<0x41>", "<s>", "</s>"]
    out = ["", " ", "a" * 700, "    x", "▁▁", " " * 100 + "abc" + " " * 37, "the" * 300, "\x00\x01", "é", "\U0010ffff", "ab 12 " * 20000]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]


def test_ids_equal_the_library(library):
    m = pc.machine()
    for t in texts():
        assert list(m.encode(t)) == library.encode(t), t[:80]


def test_round_trip(library):
    m = pc.machine()
    for t in texts():
        ids = m.encode(t)
        assert m.decode(ids) == t.replace("▁", " ") == library.decode(list(ids))


def test_shortest_path_is_the_least_of_all_accepted_paths():
    m, rng = pc.machine(), random.Random(2)

    def paths(text, before):
        if not text:
            yield 0.0, ()
        for k in range(1, len(text) + 1):
            piece = m.arcs.get(text[:k])
            if piece is not None and m.accepts(before, piece):
                for w, rest in paths(text[k:], piece):
                    yield w + m.weight[piece], (piece, *rest)

    for _ in range(80):
        text = "▁" + "".join(rng.choice("aeinrstho") for _ in range(rng.randrange(1, 9)))
        assert min(paths(text, -1))[1] == m.shortest(text)


def test_tables(spark):
    rows = [(1, "Hello world", 5, "k"), (1, "Hello world", 5, "k"), (None, None, None, None), (3, "", 0, ""), (4, "▁x", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, extra string")
    coded = pc.encode(docs)
    assert coded.columns == ["doc_id", "extra", "ids", "n_ids", "decodes"]
    got = {r["doc_id"]: r for r in coded.collect()}
    assert coded.count() == 5 and got[None]["ids"] is None and got[3]["ids"] == [] and got[3]["decodes"] and got[4]["decodes"]
    back = sorted((r["doc_id"] or 0, r["text"]) for r in pc.decode(coded).filter("doc_id is not null").collect())
    assert back == [(1, "Hello world"), (1, "Hello world"), (3, ""), (4, " x")]
    assert pc.encode(docs.limit(0)).count() == 0


def test_composition_reads_what_the_first_reads_and_writes_what_the_second_makes_of_it():
    a, b = pc.Transducer(), pc.Transducer()
    a.arc(0, "x", "y", 1.0, 0)
    a.arc(0, pc.OTHER, pc.OTHER, 0.5, 0)
    b.arc(0, "y", 7, 2.0, 0)
    b.arc(0, "z", 8, 3.0, 0)
    b.arc(0, pc.ANY, pc.BYTES, 9.0, 0)
    arcs = pc.compose(a, b).arcs[0]
    assert sorted(map(str, arcs["x"])) == sorted(map(str, [(7, 3.0, 0), ((pc.BYTES, "y"), 10.0, 0)]))
    assert sorted(map(str, arcs["z"])) == sorted(map(str, [(8, 3.5, 0), ((pc.BYTES, "z"), 9.5, 0)]))
    assert arcs[pc.OTHER] == ((pc.BYTES, 9.5, 0),)


def test_weights_choose_between_pieces_and_bytes(monkeypatch):
    text = " the漢\U0010ffff end"
    m = pc.machine()
    kinds = [m.text[i].startswith("<0x") for i in m.encode(text)]
    assert any(kinds) and not all(kinds)
    monkeypatch.setattr(pc, "BYTE_WEIGHT", 0.0)  # with free bytes the shortest path is one of bytes
    free = pc.machine()
    assert all(m.text[i].startswith("<0x") or m.weight[i] <= 0 for i in free.encode(text))
    assert free.decode(free.encode(text)).replace("▁", " ") == " " + text


def test_segments_are_where_no_piece_leads_on():
    m = pc.machine()
    for t in texts():
        parts = m.segments(t) if t else []
        assert "".join(parts) == t
        for a, b in zip(parts, parts[1:]):
            assert not any((a[-1] + b[0]).replace(" ", "▁") in p for p in m.arcs) if len(parts) < 6 else True
