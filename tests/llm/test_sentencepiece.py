import hashlib

import numpy as np
import pytest
import sentencepiece

from tests.llm.fixtures import ODD, SMALL, docs, small
from vectorloom.llm import sentencepiece_fst as S


def library():
    import public_tokenizers as P

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_query_against_library(spark):
    sp = library()
    texts = {r.doc_id: r.text or "" for r in small(spark).collect()}
    for r in S.query(spark, SMALL).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r.round_trip and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_strings():
    sp, fst = library(), S.Transducer(S.compile_model())
    rng = np.random.default_rng(0)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b    c     d", " " * 17, " " * 70 + "x", "x" * 200, "ab" * 500, "\n", "\n\n a\nb", "\t\t", "\U0001f600\U0001f600 日本語", "éß" * 40, "aa" * 33 + " " + "=" * 150, "▁x", "a\x00b", "1234567890 " * 9, "don't 'quote' \"x\""]
    texts += ["".join(chr(c) for c in rng.choice([32, 32, 97, 98, 101, 116, 10, 46, 233, 0x4E00], 200)) for _ in range(60)]
    coded = fst.encode(texts)
    for t, c in zip(texts, coded, strict=True):
        ids = np.frombuffer(c, "<i4").tolist()
        assert ids == sp.encode(t), repr(t)[:80]
        assert fst.decode(ids) == t.replace("▁", " ")


def test_odd_rows(spark):
    out = S.encode(docs(spark, ODD), keep=("doc_id", "kind")).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[1].ids is None and by[1].n_tokens is None and by[2].ids == [] and by[2].round_trip
    back = S.decode(S.encode(docs(spark, ODD))).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted(((r[0], r[1]) for r in ODD if r[0] is not None), key=lambda x: (x[0], x[1] or "")) or {(r.doc_id, r.text) for r in back} == {r[:2] for r in ODD}
    assert S.encode(docs(spark, [])).collect() == []


def unigram_model(path, rule="identity", pieces=None, squeeze=False, runs=False):
    """A unigram model with byte fallback whose scores are written down here; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 1, True, 0
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    proto.normalizer_spec.ParseFromString(spec)
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, squeeze, True
    for p, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=p, score=0.0, type=kind)
    for b in range(256):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    words = pieces or "▁ ▁t ▁th ▁the ▁a ▁an ▁and t h e a n d s i o r the he an nd and ing in ion tion at ation es er r e st est so on no ABC fi 1 2 3 12 123 ab abab ba ▁ab ▁b b".split()
    for k, p in enumerate(dict.fromkeys([*words, *(["▁▁", "▁▁▁"] if runs else [])])):
        proto.pieces.add(piece=p, score=-2.0 - (k * 0.7310585 % 5.37) - 0.013 * len(p), type=1)
    path.write_bytes(proto.SerializeToString())
    return str(path)


def composed(text, model):
    """Ids by composing small transducers with a text, arc by arc, and relaxing all arcs of the lattice until nothing changes."""
    s = S.Normaliser(model["rules"], model["prefix"], model["squeeze"])(text)
    worst = 10 - min(model["score"].values())
    arcs = [(i, i + len(p), -w, [model["ids"][p]]) for i in range(len(s)) for p, w in model["score"].items() if s.startswith(p, i)]
    arcs += [(i, i + 1, worst, [model["bytes"][b] for b in c.encode()]) for i, c in enumerate(s) if c not in model["score"]]
    best = {0: (0.0, [])}
    for a, b, w, out in sorted(arcs):
        if a in best and (b not in best or best[a][0] + w < best[b][0] - 1e-12):
            best[b] = best[a][0] + w, best[a][1] + out
    return best[len(s)][1] if s else []


STRINGS = ["", " ", "the and", "  the   nation  states ", "ation ababab", "x", "xx the", "123123 12", "éß the", "\U0001f600", "ＡＢＣ ﬁ　the", "the\nand\n\nan", "▁the", "the nation " * 40, "thethethe" * 30 + " " + "q" * 60]


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("runs", [False, True])
def test_unigram_models(tmp_path, rule, squeeze, runs):
    """Against the library and against an explicit composition, for several normalisers."""
    path = unigram_model(tmp_path / "m.model", rule, squeeze=squeeze, runs=runs)
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), S.compile_model(path)
    assert bool(model["rules"]) == (rule != "identity")
    fst = S.Transducer(model)
    rng = np.random.default_rng(1)
    texts = STRINGS + ["".join(rng.choice(list("thean dsiorgb12xＡ\n "), 60)) for _ in range(40)]
    for t, c in zip(texts, fst.encode(texts), strict=True):
        ids = np.frombuffer(c, "<i4").tolist()
        assert ids == sp.encode(t), repr(t)[:60]
        assert ids == composed(t, model), repr(t)[:60]
        assert fst.decode(ids) == sp.decode(ids)


def test_normaliser_against_library():
    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.NormalizerSpec()
        spec.ParseFromString(lib.serialized_normalizer_spec())
        mine = S.Normaliser(S.rewrite_rules(spec.precompiled_charsmap), True, True)
        rng = np.random.default_rng(2)
        texts = ["e\u0301 ﬁ Ⅷ ㌔ ｶﾞ ＡｂＣ", " a\u00a0\u3000 b ", "\u200bx\ty\r\n", "Ångström"] + ["".join(chr(c) for c in rng.integers(0x20, 0x3400, 40)) for _ in range(200)]
        for t in texts:
            assert mine(t) == lib.normalize(t), repr(t)


def test_pieces_across_blanks(tmp_path):
    """A unigram model whose pieces cross blanks is walked whole."""
    path = unigram_model(tmp_path / "m.model", pieces="▁ t h e a n d ▁the ▁the▁and and▁ ▁and nd▁the".split())
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), S.compile_model(path)
    assert not model["apart"]
    for t, c in zip(STRINGS, S.Transducer(model).encode(STRINGS), strict=True):
        assert np.frombuffer(c, "<i4").tolist() == sp.encode(t) == composed(t, model)


def test_ranks_that_tie(tmp_path):
    """A byte-pair model with equal ranks is merged directly; one without byte fallback is refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(unigram_model(tmp_path / "m.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 2
    for p in proto.pieces:
        if p.type == 1:
            p.score = -1.0 if len(p.piece) > 1 else -9.0
    (tmp_path / "b.model").write_bytes(proto.SerializeToString())
    sp, model = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "b.model")), S.compile_model(str(tmp_path / "b.model"))
    assert not model["ranked"]
    for t, c in zip(STRINGS, S.Transducer(model).encode(STRINGS), strict=True):
        assert np.frombuffer(c, "<i4").tolist() == sp.encode(t)
    proto.trainer_spec.byte_fallback = False
    (tmp_path / "c.model").write_bytes(proto.SerializeToString())
    with pytest.raises(NotImplementedError):
        S.compile_model(str(tmp_path / "c.model"))


def test_names_of_kept_columns(spark):
    with pytest.raises(ValueError):
        S.encode(docs(spark, ODD).selectExpr("*", "1 AS IDS"), keep=("IDS",))
