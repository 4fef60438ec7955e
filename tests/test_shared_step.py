"""The steps that all verdicts share: what they skip changes no result, and a side that is off is not fitted."""

import random

from pyspark.sql import functions as F

from textward.functions import features, rules
from textward.functions import text as tx
from textward.operators import models
from textward.plans import base


def _texts(spark):
    rng = random.Random(3)
    bits = ["thth", "THTH", "tion", "tıon", "TİON", "ble", "ouou", "heheha", "hehe", "a@b.c", "&&&", "&amp;", "&a b;", "***", "<b>", "<", "[id1|N],", "[club2|x]", "www.x", "http://y", "ABCDEFG", "ЁЁЁЁЁЁЁ", "SHOUT!!", "!", "!!", ".", ",", "-", " ", "  ", "\t", "\n", " ", " ", "\x1c", "\u0085", "e", "Z", "ſ", "и", "и "]
    return spark.createDataFrame([(None,), ("",), *[("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))),) for _ in range(3000)]], "text string")


def test_skipped_searches(spark):
    """Runs and marks that are looked up first, and punctuation and spaces in one search, against plain searches."""
    t = F.coalesce("text", F.lit(""))
    marks = "".join(chr(k) for k in range(0x21, 0x7F) if not chr(k).isalnum())
    plain = F.lower(t)
    for pattern, by in ((tx.URL_EMAIL, " "), (tx.TAGS_LAZY, " "), (tx.MENTION, ""), (tx.ENTITIES_GREEDY, " ")):
        plain = tx.replace(plain, pattern, by)
    spam = tx.replace(tx.replace(tx.replace(t, tx.TAGS), tx.MENTION_ID, ""), tx.ENTITIES)
    pairs = [
        (tx.normalise(F.col("text")), tx.collapse(F.translate(plain, marks, " " * len(marks)))),
        (tx.process_spam(F.col("text")), tx.drop_words(tx.collapse(spam), tx.SPAM_STOP_WORDS)),
        (features.matches_caps_word(F.col("text")), t.rlike(features.CAPS_WORD)),
        (features.matches_caps_shout(F.col("text")), t.rlike(features.CAPS_SHOUT)),
        (rules.any_hit(F.col("text"), base.LATIN), t.rlike("(?iu)" + "|".join(f"(?:{p})" for p in base.LATIN.values()))),
        *[(rules.hits(F.col("text"), p), t.rlike("(?iu)" + p)) for p in [*base.LATIN.values(), "(?:tion)+x?", "ski|(?:a|b)c", "(?:is)?e"]],
    ]
    rows = _texts(spark).select(*[F.struct(a.alias("a"), b.alias("b")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).collect()
    for k in range(len(pairs)):
        assert [r[k]["a"] for r in rows] == [r[k]["b"] for r in rows], k
        assert len({r[k]["a"] for r in rows}) > 1


def test_needed_runs():
    assert rules.needed("(?:^|[^a])thth[a-z]*") == ["thth"] and rules.needed("(?:tion|ble)$") == ["tion", "ble"]
    assert rules.needed("(?:tion)?") is None and rules.needed("ab|[cd]") is None and rules.needed("(?!ab)c*") is None and rules.needed("блин") is None


def test_fits_what_a_mode_needs(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(models, "fit_bayes", lambda df, flavour="toxicity", **_: fitted.append(flavour) or flavour)
    monkeypatch.setattr(base, "labelled", lambda *_: None)
    monkeypatch.setattr(base, "spam_labelled", lambda *_: None)
    monkeypatch.setattr(base, "_models", {})
    assert base.fitted(spark, "x", "tox_only") == ("toxicity", None) and fitted == ["toxicity"]
    assert base.fitted(spark, "x", "spam_only") == (None, "spam") and base.fitted(spark, "x") == ("toxicity", "spam") and fitted == ["toxicity", "spam"]
