"""English stems of words from the published description of the algorithm."""

from pyspark.sql import functions as F

from codelode.functions.stemmer import english_stem, shape

# Examples of the published description, by step, with the stem that all steps give.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}
KEPT = ["", "a", "is", "x1ing", "snake_cases", "éting", "by", "yes"]


def test_stems_of_the_published_examples(spark):
    words = [*STEMS, *KEPT]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in frame.select("w", english_stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in STEMS} == STEMS
    assert {w: got[w] for w in KEPT} == {w: "ye" if w == "yes" else w for w in KEPT}


def test_y_is_a_vowel_after_a_consonant(spark):
    frame = spark.createDataFrame([(w,) for w in ["toy", "syzygy", "yes", "yyy", "sayyid"]], "w string")
    assert [r.s for r in frame.select(shape(F.col("w")).alias("s")).collect()] == ["CVC", "CVCVCV", "CVC", "CVC", "CVCVVC"]
