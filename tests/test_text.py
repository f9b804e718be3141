import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wrackline.functions import predicates as K
from wrackline.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_normalised(spark):
    raw = "Café &amp; “bar” — yes… (Cont'd from Page 3) end SUBSCRIBE NOW and more"
    assert one(spark, raw, T.normalised) == "Cafe & \"bar\" - yes... end"
    assert one(spark, "T he house", T.normalised) == "The house" and one(spark, "B arbados won. T he end", T.normalised) == "Barbados won. T he end"
    assert one(spark, None, T.normalised) is None


def test_counts_and_keys(spark):
    assert one(spark, "It's a well-known 3 café", T.word_count) == 5
    assert one(spark, " A \n B ", T.canonical) == "a b"
    assert one(spark, "x", T.sha256) == hashlib.sha256(b"x").hexdigest()
    assert one(spark, "<|de|> MUSIC playing", T.clean_audio) == ""
    assert one(spark, "checkpoint-12", T.step_of) == 12 and one(spark, "checkpoint-x", T.step_of) is None
    assert one(spark, " 31.5 W", T.watts) == 31.5 and one(spark, "N/A", T.watts) == 0.0


def test_simhash_against_votes(spark):
    text = "one two three four five six seven eight"
    tokens = re.findall(r"\w+", text)
    parts = {" ".join(tokens[i : i + 5]) for i in range(4)}
    hashes = [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") for p in parts]
    want = sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) >= 0)
    assert one(spark, text, T.simhash) % 2**64 == want
    assert one(spark, "", T.simhash) % 2**64 == int.from_bytes(hashlib.blake2b(b"", digest_size=8).digest(), "big")


@pytest.mark.parametrize(
    ("text", "noise", "caption"),
    [("<!-- x -->", True, False), ("Page 12", True, False), ("$2.50 VAT Inclusive", True, False), ("Kick-off 19:30", True, False), ("(Cont'd on next page)", True, False), ("(db)", False, False), ("(DB)", True, False), ("www.x.org", True, False), ("Pictured the team", False, True), ("He accepts a plaque.", False, True), ('He said "accepts".', False, False), ("Plain words here.", False, False)],
)
def test_noise_and_captions(spark, text, noise, caption):
    assert one(spark, text, K.is_noise) is noise
    assert one(spark, text, K.is_caption) is caption


def test_prose_and_headings(spark):
    assert one(spark, "a b c d e f one two three four five six", K.is_corrupt) is True
    assert one(spark, "The council met today and agreed on the new plan.", K.is_prose) is True
    assert one(spark, "By Jane Doe", K.is_useful_heading) is False
    assert one(spark, "RED TEAM VS. BLUE TEAM", K.is_useful_heading) is False
    follow = F.lit("The council met on Monday and agreed that the new plan would go ahead at once.")
    assert one(spark, "Council agrees plan", lambda c: K.is_plain_heading(c, follow)) is True
    assert one(spark, "Council agrees plan.", lambda c: K.is_plain_heading(c, follow)) is False
    assert one(spark, "London news", K.is_off_domain) is True and one(spark, "London and Bridgetown", K.is_off_domain) is False


@pytest.mark.parametrize("text", ["The Advocate, Established October 1895", "Established October 1895 and more", "RUNOVER from 3", "Council on Front Page 2", "(See story on Page 4)", "BELOW RIGHT: a man", "Email: x@y.z", "SUBSCRIBE NOW for more"])
def test_furniture_as_printed(spark, text):
    assert one(spark, text, K.is_noise) is True
    assert one(spark, "Established October 1896", K.is_noise) is False


def test_legal_notices_as_printed(spark):
    assert one(spark, "In the Supreme Court of Barbados", K.is_legal_notice) is True and one(spark, "the Supreme Court of Jamaica", K.is_legal_notice) is False
    assert one(spark, "x" * 600 + " Claim No. 12/34", K.is_legal_notice) is False
    for name in ("Saint Lucy", "St. Lucy", "Bajan", "barbadians", "UWI"):
        assert one(spark, f"London and {name}", K.is_off_domain) is False
    assert one(spark, "Said in Paris (AP)", K.is_off_domain) is True and one(spark, "Israel", K.is_off_domain) is True and one(spark, "Tunisias", K.is_off_domain) is False


def test_simhash_md5_against_votes(spark):
    text = "One two three four five six seven eight nine two three four five six"
    tokens = re.findall(r"\w+", text.lower())
    parts = {" ".join(tokens[i : i + 5]) for i in range(len(tokens) - 4)}
    hashes = [int(hashlib.md5(p.encode()).hexdigest()[16:], 16) for p in parts]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
    assert one(spark, text, T.simhash_md5) % 2**64 == want
