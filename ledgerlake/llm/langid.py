"""Language identification in two steps: family, then language.

Features are hashed character bigrams and trigrams of the letters of the whole
text (square roots of counts, unit length). A multinomial logistic regression
predicts the language family; inside the family one linear support vector
machine for each pair of languages votes. All models are fitted by Spark ML on
a bounded sample of labelled rows (``PER_LANGUAGE`` expected rows of each
language, taken by a hash of the id, so that reruns agree), and applied by an
Arrow-batched function that sees the text and nothing else. Coefficients are a
few dozen KB per model and travel with the function.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, table, unit_hash
from .langmodel import DIM, UND, Model, count_letters, featurize, predict_all

#: Families of languages by code; a code that is not listed is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

PER_LANGUAGE = 1000       # expected sample rows of a language
#: A letter belongs to the learned alphabet from this share of all sampled letters.
ALPHABET_SHARE = 1e-5


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` that have id, text and language."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        unit_hash(F.lit("langid"), F.col(id_col)).alias("u"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return Model([], {})
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(per_language / n)) for lang, n in sorted(counts.items())])
    sample = kept(rows.where(F.col("u") < share).select("lang", "text").repartition(8, F.xxhash64("text")))
    letters = (sample.select("text").mapInArrow(count_letters, "code long, n long")
               .groupBy("code").agg(F.sum("n").alias("n")).where("code <> 32").collect())   # a row per letter
    total = sum(r["n"] for r in letters)
    alphabet = np.array(sorted(r["code"] for r in letters if r["n"] >= ALPHABET_SHARE * total), np.uint32)

    langs = sorted({r["lang"] for r in sample.select("lang").distinct().collect()})
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(FAMILY_OF.get(lang.lower(), lang), []).append(lang)
    families = sorted(members)
    model = Model(families, members, np.zeros((len(families), DIM)), np.zeros(len(families)), [], alphabet)
    rows = kept(sample.mapInArrow(featurize, "lang string, x array<float>")).select(
        "lang", array_to_vector("x").alias("features"))
    number = {lang: float(i) for i, f in enumerate(families) for lang in members[f]}

    def labelled(frame, of):
        return frame.select("features", F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in of.items()]).alias("label"))
    if len(families) > 1:
        lr = LogisticRegression(family="multinomial", regParam=1e-5, maxIter=40, standardization=False)
        m = lr.fit(labelled(rows, number))
        model.family_coef = m.coefficientMatrix.toArray()
        model.family_bias = m.interceptVector.toArray()
    for family in families:
        for a, b in combinations(members[family], 2):
            svm = LinearSVC(regParam=1e-4, maxIter=40, standardization=False)
            m = svm.fit(labelled(rows.where(F.col("lang").isin(a, b)), {a: 1.0, b: 0.0}))
            model.pairs.append((a, b, m.coefficients.toArray(), float(m.intercept)))
    return model


def predicted(model: Model, text: Column) -> Column:
    """Struct (lang, score) from the whole text."""
    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        return predict_all(model, texts)
    return predict(text)


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, mod 4, is 2. A row
    without id is neither learned from nor held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``docs`` (all its columns) with ``_ll_pred``, a struct (lang, score).

    Defined cases: a null text, or one without letters, is ``und`` with score
    0, as is every text where nothing could be learned; repeated rows get
    equal predictions; texts of any length are read whole.
    """
    return docs.withColumn("_ll_pred", predicted(fit(train, id_col, text_col, lang_col), F.col(text_col)))


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    return digest(identify(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id")))))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        F.col("_ll_pred.lang").alias("lang_pred"), F.col("_ll_pred.score").alias("score"))
