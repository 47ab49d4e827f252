"""BPE against the tokenizers library; chat formatting by exact round trip."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricewell.llm import bpe, chat
from pricewell.llm.common import env_path

PATH = env_path("byte_bpe_50k.json")
ALPHABET = [*"ab 'st  \n\t\r\x0b\x1c\x1f\x85\xa0 　é²½ⅷ٣日本'llve've!?.,#$$​😀́Ω_-", "<|endoftext|>", "'s", " the", " of"]


def test_encode_and_decode_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    want, mine, r = tokenizers.Tokenizer.from_file(PATH), bpe.Codec(PATH), random.Random(1)
    texts = ["", " ", "  ", "\n \n", "a  b", "x" * 5000, " the" * 2000] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for t in texts:
        ids = want.encode(t, add_special_tokens=False).ids
        assert list(mine.encode(t)) == ids, repr(t)
        assert mine.decode(ids) == want.decode(ids, skip_special_tokens=False)
    assert mine.decode([157]) == want.decode([157], skip_special_tokens=False)


def test_cache_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    a, text = bpe.Codec(PATH), "one two three four five six one two, three. four! five"
    first = a.encode(text)
    assert a.encode(text) == first
    assert a.decode(first) == text


def test_frames(spark):
    d = spark.createDataFrame([(1, "Hello world", 7), (2, None, 8), (3, "", 9), (1, "Hello world", 7)], "doc_id long, text string, ids long")
    got = bpe.encode(d, PATH, keep=["doc_id"]).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in got) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    back = bpe.decode(bpe.encode(d, PATH, keep=["doc_id"]), PATH)
    assert sorted(r["text"] for r in back.collect()) == ["", "", "Hello world", "Hello world"]
    digest = {r["doc_id"]: r for r in bpe.round_trip(d.select("doc_id", "text"), PATH).collect()}
    assert digest[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digest[1]["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    assert bpe.encode(d.limit(0), PATH).count() == 0


SAID = [r"\### Assistant: </turn> ok", "a\\", "\\\\</turn>\n### user: x", "", None, "### ", "é\n日本", "</turn", "x" * 20_000, "<<</turn></turn>"]


def test_chat_round_trip(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "odd: role\n", None]), r.choice(SAID), "x") for c in range(60) for t in range(r.randint(1, 7))]
    rows += [(None, 1, "assistant", "no id", "x"), (5, None, "user", "no turn", "x"), (1, 0, "user", "same", "x"), (1, 0, "user", "same", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    made = chat.format_conversations(d)
    shown = made.withColumn("turns", chat.parse(F.col("text"))).withColumn("reply", chat.trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))).collect()
    for c in {x[0] for x in rows}:
        turns = sorted([(t is not None, t or 0, ro or "", te or "") for cc, t, ro, te, _ in rows if cc == c])
        want = [(ro, te) for *_, ro, te in turns]
        mine = sorted([x for x in shown if x["conv_id"] == c], key=lambda x: x["example"])
        ends = [k for k in range(1, len(want) + 1) if want[k - 1][0] == "assistant" or k == len(want)]
        assert [x["n_turns"] for x in mine] == ends
        for x in mine:
            assert [(y["role"], y["text"]) for y in x["turns"]] == want[: x["n_turns"]]
            role, text = want[x["n_turns"] - 1]
            assert x["reply"] == (text if role == "assistant" else None)
    assert chat.format_conversations(d.limit(0)).count() == 0


def test_round_trip_replaces_clashing_columns(spark):
    d = spark.createDataFrame([(1, "Hello world", "x", "y")], "doc_id long, text string, n_tokens string, ids_sha256 string")
    got = bpe.round_trip(d, PATH)
    assert sorted(got.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"] and got.first()["n_tokens"] == 2


def test_long_roles_and_texts(spark):
    big = 1_000_000
    rows = [(1, 0, "r" * big, "t"), (1, 1, "assistant", "\\<" * (big // 2)), (2, 0, ":" * 3_000, "a"), (2, 1, "assistant", "x" * big)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(d).filter("n_turns = 2").select("conv_id", chat.parse(F.col("text")).alias("turns"), chat.trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply")).collect()
    for r in made:
        want = [(ro, te) for c, _, ro, te in rows if c == r["conv_id"]]
        assert [(x["role"], x["text"]) for x in r["turns"]] == want and r["reply"] == want[1][1]


def test_query_digests(spark):
    from pricewell.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, r, SAID[0]) for k, r in enumerate(("user", "assistant"))]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(ro, te or "") for _, _, ro, te in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        loss = "".join(te for ro, te in turns if ro == "assistant")
        want[c] = (len(turns), sha("".join(f"{ro}\n{te}\n" for ro, te in turns)), len(loss), sha(loss))
    got = queries.op2_chat_formatting(spark, sf).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)
