import random

import sentencepiece as sp

from siftline.llm import sentencepiece_stream as m

HARD = ["", " ", "  ", "a  b", " a", "a ", "日本語テキスト", "\U0001f600x\n\n\ny", "a" * 700, "\t\ttab", "internationalization" * 9, "a   ", "\x00z", "<s>hi</s>", "=-=-=-=-=------________" * 5, "<0x41>", " nb", "é", "he said,\"ok\""]


def test_equals_library():
    lib, enc = sp.SentencePieceProcessor(model_file=m.model_path()), m.StreamEncoder()
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("abcdeinrst  -=.é\n") for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        assert enc.encode(t) == lib.encode(t), t
        assert enc.decode(enc.encode(t)) == t


def test_streamed_path_equals_library_in_a_bounded_window():
    lib = sp.SentencePieceProcessor(model_file=m.model_path())
    lattice = m.Lattice(m.Pieces.load(m.model_path()))
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choice(["ing", "er", "th", "x", "=", "--", "é", "9"]) for _ in range(80))
        assert [*lattice.feed(m.SPACE + word), *lattice.close()] == lib.encode(word, out_type=str)
    text = "internationalization" * 500
    got = [*lattice.feed(m.SPACE + text)]
    assert lattice.peak <= 2 * lattice.p.longest + 2
    assert got + lattice.close() == lib.encode(text, out_type=str)


def best_sum(text, pieces):
    low, best = pieces.low, [(0.0, [])]
    for at in range(1, len(text) + 1):
        options = []
        for size in range(1, min(at, pieces.longest) + 1):
            found = pieces.scores.get(text[at - size : at])
            if found or size == 1:
                s, path = best[at - size]
                options.append((s + (found[1] if found else low), path + [text[at - size : at]]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][0]


def test_unigram_viterbi_against_whole_table():
    rng = random.Random(4)
    scores = {}
    while len(scores) < 60:
        scores.setdefault("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))), (len(scores), -rng.random() * 9 - 1))
    pieces = m.Pieces(scores, None, merges=False)
    lattice = m.Lattice(pieces)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 120)))
        got = [*lattice.feed(text), *lattice.close()]
        assert "".join(got) == text
        assert abs(sum(scores[p][1] if p in scores else pieces.low for p in got) - best_sum(text, pieces)) < 1e-6


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate([*HARD, None])] + [(None, "no id", "x"), (0, "again", "x"), (0, "again", "x"), (99, "word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lib = sp.SentencePieceProcessor(model_file=m.model_path())
    coded = m.encode_documents(docs)
    got = sorted((str(r.doc_id), r.ids, r.n_tokens, r.round_trip) for r in coded.collect())
    assert got == sorted((str(i), lib.encode(t or ""), len(lib.encode(t or "")), True) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.text) for r in m.decode_documents(coded).collect()) == sorted((str(i), t or "") for i, t, _ in rows)
    assert m.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_model_settings_are_read(tmp_path):
    data = open(m.model_path(), "rb").read()
    parts = {k: v for k, v in m.proto_fields(data) if k in (2, 3)}
    changed = tmp_path / "changed.model"

    def rule(number, old, new):
        changed.write_bytes(data.replace(parts[number], parts[number].replace(old, new)))
        return m.merges_of(str(changed))

    assert m.merges_of(m.model_path())
    assert rule(2, b"\x18\x02", b"\x18\x01") is False and not m.Pieces.load(str(changed)).merges
    for number, old, new in ((2, b"\x18\x02", b"\x18\x03"), (3, b"\x20\x00", b"\x20\x01"), (3, b"\x18\x01", b"\x18\x00")):
        try:
            rule(number, old, new)
            raise AssertionError("not refused")
        except m.UnsupportedModel:
            pass
