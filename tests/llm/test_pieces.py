import hashlib
import random

import pyarrow.parquet as pq
import pytest
import sentencepiece

from terrastrata.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Pieces(P.read_model(P.MODEL))


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def every_way(p, text, before=""):
    """All segmentations (score, ids) of a short text, by plain recursion over the rules."""
    if not text:
        return [(0, ())]
    parts = [(t, (i,), p.stored[i]) for t in (text[:k] for k in range(1, len(text) + 1)) if t in p.rank for i in [p.texts.index(t)]]
    if text[0] not in p.rank:
        parts.append((text[0], tuple(p.byte_ids[b] for b in text[0].encode()), p.spelled_score))
    out = []
    for t, ids, s in parts:
        if p.merges and p.merged(before + t) != [x for x in (before, t) if x]:
            s -= P.JUNCTION
        out += [(s + a, (*ids, *b)) for a, b in every_way(p, text[len(t) :], t)]
    return out


TEXTS = ["the cat sat", "Übermaß 日本 😀", "a  b\n\nc ", " lead", "zzzz", "in on an"]


def test_search_yields_all_in_order(vocabulary):
    for t in ["the", " thin", "é日x", " ab  ", "▁a"]:
        got, want = list(vocabulary.segmentations(t, [])), every_way(vocabulary, t)
        assert [s for s, _ in got] == sorted((s for s, _ in want), reverse=True)
        assert {(s, tuple(i)) for s, i in got} == set(want)


def test_agenda_shows_the_next_score(vocabulary):
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice("abeinorst hé日²,") for _ in range(r.randint(1, 12)))
        agenda = []
        found = vocabulary.segmentations(t, agenda)
        next(found)
        shown = -agenda[0][0] if agenda else None
        second = next(found, None)
        assert shown == (second[0] if second else None)
        assert "".join(vocabulary.stretch.findall(t)) == t


def test_best_is_the_vocabularys_own_encoding(vocabulary, own):
    e = P.Encoder(vocabulary)
    r = random.Random(5)
    bits = ["the", "Zug", " ", "  ", "\n", "\t", "é", "日本", "😀", "ß", "m²", "12", ".", "́", "\r\n", "ation", "Ñandú", "_", "  x"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    for t in [*TEXTS, "", "x" * 3000, " " * 300, *made, *pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]:
        ids, scores, _ = e.encode(t)
        assert ids.tolist() == own.encode(t or "") and e.parts(scores[0])[1] == 0, t[:80]


def test_n_best_of_texts_equal_brute_force(vocabulary):
    e = P.Encoder(vocabulary, 6)
    for t in ["an in", "the a b", "at\non it", "x  y", "é o", "m², a", "a_b c2"]:
        ids, scores, changes = e.encode(t)
        ways = sorted(every_way(vocabulary, " " + t), key=lambda x: -x[0])
        assert scores == [s for s, _ in ways[:6]], t
        by_ids = {i: s for s, i in ways}
        made = [tuple(P.changed(ids.tolist(), c)) for c in changes]
        assert made[0] == tuple(ids) and len(set(made)) == len(made) and [by_ids[m] for m in made] == scores
        assert all(P.decode(vocabulary, m) == t for m in made)


def test_little_room_changes_nothing(vocabulary):
    e, tight = P.Encoder(vocabulary), P.Encoder(vocabulary, cache_bytes=2000)
    for t in TEXTS * 3:
        a, b = e.encode(t), tight.encode(t)
        assert a[0].tolist() == b[0].tolist() and a[1:] == b[1:]


def test_a_unigram_file_with_pieces_over_borders():
    """A model put together by hand, none trained: scores as stored, the search over the whole text."""
    made = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    kinds = {"<unk>": 2, "<s>": 3, "</s>": 3}
    scored = {"<unk>": 0.0, "<s>": 0.0, "</s>": 0.0, "▁": -3.1, "of": -2.3, "▁of": -1.9, "▁of▁the": -2.5, "▁the": -2.2, "the": -2.7, "t": -4.2, "h": -4.4, "e": -3.6, "o": -4.1, "f": -4.9, "▁o": -3.3, "he": -3.9}
    for i, (t, s) in enumerate([*scored.items(), *((f"<0x{b:02X}>", 0.0) for b in range(256))]):
        made.pieces.add(piece=t, score=s, type=kinds.get(t, 1) if i < len(scored) else 6)
    made.trainer_spec.model_type, made.trainer_spec.byte_fallback = 1, True
    made.normalizer_spec.name, made.normalizer_spec.add_dummy_prefix, made.normalizer_spec.remove_extra_whitespaces, made.normalizer_spec.escape_whitespaces = "identity", True, False, True
    data = made.SerializeToString()
    own, p = sentencepiece.SentencePieceProcessor(model_proto=data), P.Pieces(data)
    e = P.Encoder(p, 5)
    assert not p.merges and p.stretch is P.CUTS[2][0]
    for t in ["of the", "the of the", "often the", "of theo the", "é of"]:
        ids, scores, changes = e.encode(t)
        assert ids.tolist() == own.encode(t), t
        if t.isascii():
            assert {tuple(P.changed(ids.tolist(), c)) for c in changes} == set(map(tuple, own.nbest_encode(t, nbest_size=5))), t
        ways = sorted(every_way(p, " " + t), key=lambda x: -x[0])
        assert scores == [s for s, _ in ways[: len(scores)]] and P.decode(p, ids) == t


def test_round_trip(vocabulary):
    r, e = random.Random(1), P.Encoder(vocabulary)
    bits = ["the", "Zug", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "\x00", "ß", "m²", "12", ".", "́", "\r\n"]
    for t in [*TEXTS, "▁x ▁", "x" * 50_000, " " * 3000, *("".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400))]:
        assert P.decode(vocabulary, e.encode(t)[0]) == t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, docs_of, saved, vocabulary, own):
    """Ids against the vocabulary's own encoder, the N best against all segmentations of short texts; null, empty, repeated and very long texts; clashing columns."""
    short = ["an in", "the", "x  y", "é o", "at\non"]
    ts = [None, "", *TEXTS, "the cat sat", "word " * 30_000, *short]
    rows = {x.doc_id: x for x in P.op4_sentencepiece(spark, saved(documents=docs_of(ts))).collect()}
    wide = docs_of(ts).withColumnRenamed("fp", "scores")
    kept = {x.doc_id: x for x in P.encoded(wide).collect()}
    assert len(rows) == len(ts) and all(x.exact for x in rows.values())
    for i, t in enumerate(ts):
        ids, x = own.encode(t or ""), rows[i]
        joined = ",".join(map(str, ids))
        assert x.n_pieces == len(ids) and x.ids_sha256 == sha(joined) and x.decoded_sha256 == sha(t or ""), t
        shown = [[f"{{{c['at']}, {c['n']}, [{', '.join(map(str, c['ids']))}]}}" for c in way] for way in kept[i].changes]
        assert x.n_best_sha256 == sha(f"{joined}|[{', '.join('[' + ', '.join(way) + ']' for way in shown)}]")
        if t in short:
            ways = sorted(every_way(vocabulary, " " + t), key=lambda x: -x[0])[: P.BEST]
            assert len({s for s, _ in ways}) == len(ways)
            assert [P.changed(ids, [(c["at"], c["n"], c["ids"]) for c in way]) for way in kept[i].changes] == [list(y) for _, y in ways]
            junctions, ranks = divmod(-ways[1][0], P.JUNCTION)
            assert (x.second_score, x.second_junctions, x.n_best) == (-ranks, junctions, len(ways)) and x.score == ways[0][0]
    assert tuple(rows[2])[1:] == tuple(rows[8])[1:] and rows[0].ids_sha256 == rows[1].ids_sha256
    assert P.op4_sentencepiece(spark, saved(documents=docs_of(["x"]).limit(0))).collect() == []
    back = {x.doc_id: x.text for x in P.decoded(P.encoded(wide)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ts))
