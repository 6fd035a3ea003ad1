"""Creative text features, scoring and recommendations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.expr import clamp, count_hits, first_of, hash_bucket, lookup, once, words
from spendlens.operators.joins import with_benchmark
from spendlens.operators.monitoring import out_of_fold
from spendlens.session import staged

c = F.col

# Word lists, codes, weights and benchmarks.
POWER_TOKENS = ["free", "new", "save", "exclusive", "limited", "now", "today", "best", "guaranteed"]
URGENCY_TOKENS = ["hurry", "limited", "ends", "last", "now", "today", "only"]
SOCIAL_TOKENS = ["best-selling", "popular", "loved", "rated", "reviewed", "trusted"]
CTA_CODES = {"SHOP_NOW": 1, "LEARN_MORE": 2, "SIGN_UP": 3, "BUY_NOW": 4, "BOOK_NOW": 5, "DOWNLOAD": 6, "GET_OFFER": 7, "CONTACT_US": 8}
POSITIVE = ["great", "amazing", "love", "best", "perfect", "excellent", "awesome", "fantastic", "incredible", "wonderful"]
NEGATIVE = ["bad", "worst", "terrible", "horrible", "poor", "awful"]
POWER_WORDS = {
    "urgency": ["now", "today", "limited", "hurry", "last chance", "expires", "ending"],
    "exclusivity": ["exclusive", "members only", "vip", "premium", "first"],
    "benefit": ["free", "save", "bonus", "extra", "discount", "guaranteed"],
    "emotion": ["amazing", "incredible", "love", "best", "perfect", "revolutionary"],
}
URGENT_CTAS = ["shop_now", "buy_now", "get_started", "sign_up"]
COLOR_SCORES = {"blue": 0.85, "red": 0.80, "green": 0.75, "orange": 0.82, "yellow": 0.70, "purple": 0.78, "black": 0.72, "white": 0.65}
INDUSTRY_BENCHMARKS = {
    "ecommerce": {"ctr": 0.025, "cvr": 0.012}, "saas": {"ctr": 0.022, "cvr": 0.018}, "finance": {"ctr": 0.019, "cvr": 0.008},
    "healthcare": {"ctr": 0.021, "cvr": 0.010}, "education": {"ctr": 0.028, "cvr": 0.015}, "default": {"ctr": 0.022, "cvr": 0.010},
}
PLATFORM_MULTIPLIERS = {"meta": {"ctr": 1.0, "cvr": 1.0}, "google": {"ctr": 0.9, "cvr": 1.2}, "tiktok": {"ctr": 1.3, "cvr": 0.8}}
ADVICE = {
    "short": "Headline is too short - aim for 5-8 words for optimal engagement",
    "long": "Headline is too long - consider shortening to 5-8 words",
    "face": "Consider adding a human face to increase engagement by ~15%",
    "number": "Adding specific numbers (e.g., '50% off') can boost CTR by 12%",
    "urgency": "Add urgency words like 'limited time' or 'today only' to CTA",
    "exclusivity": "Words like 'exclusive' or 'VIP' can increase perceived value",
    "readability": "Simplify text for better readability - use shorter words and sentences",
    "emoji": "TikTok audiences respond well to emojis - consider adding 1-2",
}
COLOR_EMOTIONS = {
    "red": {"excitement": 0.9, "urgency": 0.8, "passion": 0.85}, "blue": {"trust": 0.9, "calm": 0.85, "professional": 0.8},
    "green": {"nature": 0.9, "health": 0.85, "growth": 0.8}, "yellow": {"optimism": 0.85, "attention": 0.9, "warmth": 0.75},
    "orange": {"energy": 0.85, "fun": 0.8, "enthusiasm": 0.85}, "purple": {"luxury": 0.85, "creativity": 0.8, "mystery": 0.75},
    "black": {"sophistication": 0.9, "power": 0.85, "elegance": 0.8}, "white": {"purity": 0.85, "simplicity": 0.9, "clean": 0.85},
}
HOOK_FRAMES = 90


def full_text() -> Column:
    return F.concat(c("headline"), F.lit(" "), F.coalesce("body", F.lit("")))


def _token_hits(tokens: list[str]) -> Column:
    return F.size(F.filter("__tokens", lambda w: w.isin(tokens)))


def store_features(df: DataFrame) -> DataFrame:
    """Text features of the feature store: lengths, character classes and exact tokens."""
    t = c("__text")
    n = F.length(t)
    return once(once(df, {"__text": full_text()}), {"__tokens": words(F.lower("__text"))}).select(
        "creative_id", F.length("headline").alias("headline_length"), F.length(F.coalesce("body", F.lit(""))).alias("body_length"),
        n.alias("total_text_length"), F.size("__tokens").alias("word_count"),
        (F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(n, F.lit(1))).alias("uppercase_ratio"),
        F.regexp_count(t, F.lit(r"\p{Nd}")).alias("digit_count"), F.regexp_count(t, F.lit("[!?.,;:]")).alias("punctuation_count"),
        F.regexp_count(t, F.lit("!")).alias("exclamation_count"), F.regexp_count(t, F.lit(r"\?")).alias("question_count"),
        F.regexp_count(t, F.lit(r"[\x{1F019}-\x{10FFFF}]")).alias("emoji_count"),
        lookup(CTA_CODES, F.coalesce("cta", F.lit("LEARN_MORE")), 0).alias("cta_type_encoded"),
        _token_hits(POWER_TOKENS).alias("power_word_count"), _token_hits(URGENCY_TOKENS).alias("urgency_score"),
        _token_hits(SOCIAL_TOKENS).alias("social_proof_score"))


def sentiment(pos: Column, neg: Column) -> Column:
    """From the substring hits in lower-cased text, so 'unlovely' counts as 'love'."""
    return F.when(pos + neg == 0, 0.6).otherwise((pos - neg) * 0.1 + 0.5)


def readability(text: Column, n: Column) -> Column:
    """From the text and its number of words."""
    letters = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    sentences = F.greatest(F.length(text) - F.length(F.translate(text, ".!?", "")), F.lit(1))
    return clamp(100 - letters / F.greatest(n, F.lit(1)) * 5 - n / sentences * 2, 0, 100)


def cta_urgency(cta: Column, low: Column) -> Column:
    hits = count_hits(low, POWER_WORDS["urgency"])
    urgent = F.replace(F.lower(F.coalesce(cta, F.lit(""))), F.lit(" "), F.lit("_")).isin(URGENT_CTAS)
    return F.least(F.lit(1.0), F.lit(0.3) + hits * 0.1 + F.when(urgent, 0.2).otherwise(0.0))


def power_scores(low: Column) -> dict[str, Column]:
    return {f"power_{k}": F.least(F.lit(1.0), count_hits(low, v) * 0.25) for k, v in POWER_WORDS.items()}


def color_score(colors: Column) -> Column:
    """Mean weight of the named colours, .6 for an unknown one, .7 for none."""
    scores = F.transform(colors, lambda x: lookup(COLOR_SCORES, F.lower(x), 0.6))
    total = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(colors) > 0, F.least(F.lit(1.0), F.try_divide(total, F.size(colors)))).otherwise(0.7)


def predictor_features(df: DataFrame) -> DataFrame:
    """Headline and text features of the predictor; colours default to blue and white."""
    colors = c("colors") if "colors" in df.columns else F.array(F.lit("blue"), F.lit("white"))
    face = c("has_face") if "has_face" in df.columns else F.lit(False)
    df = once(df, {"__text": full_text()})
    df = once(df, {"__low": F.lower("__text"), "__n": F.regexp_count(c("__text"), F.lit(r"\S+"))})
    low = c("__low")
    df = once(df, {"__pos": count_hits(low, POSITIVE), "__neg": count_hits(low, NEGATIVE), "__read": readability(c("__text"), c("__n"))})
    return once(df, {
        "headline_length": F.length("headline"), "headline_words": F.size(words("headline")),
        "has_numbers": c("headline").rlike(r"\p{Nd}"), "has_question": F.contains(c("headline"), F.lit("?")),
        "has_exclamation": F.contains(c("headline"), F.lit("!")), "has_emoji": c("headline").rlike(r"[\x{1F300}-\x{1F9FF}]"),
        "sentiment": sentiment(c("__pos"), c("__neg")), "readability": c("__read"), "urgency": cta_urgency(c("cta"), low),
        "color_score": color_score(colors), "face": face, **power_scores(low)}).drop("__text", "__low", "__read", "__n", "__pos", "__neg")


def predict(df: DataFrame) -> DataFrame:
    """CTR / CVR, quality scores and recommendations for every creative."""
    f = with_benchmark(predictor_features(df), INDUSTRY_BENCHMARKS, PLATFORM_MULTIPLIERS)
    w = c("headline_words")
    modifier = (F.when(w.between(5, 8), 1.15).when(w > 12, 0.85).otherwise(1.0)
                * F.when(c("has_numbers"), 1.12).otherwise(1.0) * F.when(c("has_question"), 1.08).otherwise(1.0)
                * F.when(c("face"), 1.18).otherwise(1.0) * (c("urgency") * 0.15 + 1))
    for k in POWER_WORDS:
        modifier = modifier * (c(f"power_{k}") * 0.05 + 1)
    modifier = modifier * (c("color_score") * 0.4 + 0.8)
    f = once(f, {"modifier": modifier})
    media = c("media_url").isNotNull() if "media_url" in df.columns else F.lit(False)
    given = lambda x: F.when(F.coalesce(x, F.lit("")) != "", 0.05).otherwise(0.0)
    f = once(f, {
        "predicted_ctr": F.round(F.least(F.lit(0.10), c("base_ctr") * c("ctr_mult") * c("modifier")), 4),
        "predicted_cvr": F.round(F.least(F.lit(0.05), c("base_cvr") * c("cvr_mult") * c("modifier") * 0.9), 4),
        "confidence": F.round(F.lit(0.75) + given(c("body")) + given(c("cta")) + F.when(media, 0.10).otherwise(0.0), 2),
        "hook": F.least(F.lit(100.0), w * 3 + c("urgency") * 30 + 50 + F.when(c("has_question"), 15).otherwise(0)),
        "color_psychology": c("color_score") * 100, "brand_consistency": hash_bucket(c("headline"), 20) + 70.0,
        "text_sentiment": c("sentiment") * 100})
    quality = ["hook", "color_psychology", "brand_consistency", "text_sentiment", "readability"]
    total = F.lit(0.0)
    for q in quality:
        total = total + c(q)
    f = f.withColumn("overall_quality", total / 5)
    f = once(f, {f"{q}_score": F.round(q, 1) for q in [*quality, "overall_quality"]})
    return f.withColumn("recommendations", recommendations())


def recommendations() -> Column:
    """First five advice texts in rule order."""
    say = lambda when, key: F.when(when, ADVICE[key])
    w = c("headline_words")
    return F.slice(first_of(
        F.when(w < 5, ADVICE["short"]).when(w > 10, ADVICE["long"]), say(~c("face"), "face"), say(~c("has_numbers"), "number"),
        say(c("power_urgency") < 0.25, "urgency"), say(c("power_exclusivity") < 0.25, "exclusivity"), say(c("readability") < 60, "readability"),
        say((c("platform") == "tiktok") & ~c("has_emoji"), "emoji")), 1, 5)


def best_variant(scored: DataFrame, group: str) -> DataFrame:
    """First maximum of overall quality per group; no cap on the batch size."""
    return scored.groupBy(group).agg(
        F.max_by("creative_id", F.struct(c("overall_quality_score"), -c("creative_id"))).alias("best_creative_id"),
        F.max("overall_quality_score").alias("best_quality"), F.count(F.lit(1)).alias("variants"))


def batch_scoring(df: DataFrame) -> DataFrame:
    return predict(df).withColumn("recommendations", F.slice("recommendations", 1, 3))


def text_tokens(text: Column) -> Column:
    """Tokens of two characters and more, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)


def term_counts(df: DataFrame, key: str, text: Column, only: list[str] | None = None) -> DataFrame:
    """(key, term, n): tokens of every row's text, or those of the terms named."""
    tokens = text_tokens(text)
    if only is not None:
        tokens = F.filter(tokens, lambda w: w.isin(only))
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, terms: int) -> DataFrame:
    """(term, total, documents) of the most frequent terms, ties in the order of the terms: an aggregate and a top-k, no sort of all terms."""
    return counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("documents")).orderBy(F.desc("total"), "term").limit(terms)


def tfidf(df: DataFrame, key: str = "creative_id", terms: int = 100) -> DataFrame:
    """(key, term, n, weight) for the most frequent terms over the full text; weight is n * ln((rows + 1) / (rows with the term + 1)).

    The terms are chosen first, by their totals alone, so that rows and terms meet for the chosen ones only.
    """
    totals = df.select(F.explode(text_tokens(full_text())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    frequent = [r["term"] for r in totals.orderBy(F.desc("total"), "term").limit(terms).collect()]
    counts = staged(term_counts(df, key, full_text(), frequent), "terms")
    idf = F.log((df.select(F.count(F.lit(1)) + 1).scalar()).cast("double") / (F.col("documents") + 1).cast("double"))
    chosen = vocabulary(counts, terms).withColumn("idf", idf)
    return counts.join(chosen.select("term", "idf"), "term").select(key, "term", "n", (F.col("n") * F.col("idf")).alias("weight"))


TRAIN_INPUTS = ["headline_length", "headline_words", "has_numbers_n", "sentiment", "urgency"]


def train_inputs(df: DataFrame) -> DataFrame:
    """df with the five features; rows that have them already stay as they are."""
    if set(TRAIN_INPUTS) <= set(df.columns):
        return df
    return predictor_features(df).withColumn("has_numbers_n", c("has_numbers").cast("int"))


def train_creative(df: DataFrame, label: Column, trees: int = 100, depth: int = 5, seed: int = 42):
    """Gradient-boosted trees on five text features; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = train_inputs(df).withColumn("label", label.cast("double"))
    steps = [VectorAssembler(inputCols=TRAIN_INPUTS, outputCol="inputs"), GBTClassifier(featuresCol="inputs", maxIter=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def train_rate(df: DataFrame, rate: Column, trees: int = 20, depth: int = 3, leaf: int = 15, seed: int = 42):
    """Boosted regression of a rate (click, conversion) on the five text features; rows without the rate are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = train_inputs(df).withColumn("label", rate.cast("double")).where("label is not null")
    steps = [VectorAssembler(inputCols=TRAIN_INPUTS, outputCol="inputs"), GBTRegressor(featuresCol="inputs", maxIter=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def rate_scores(df: DataFrame, rate: Column, key: str = "creative_id", folds: int = 2, **fitting) -> DataFrame:
    """Every creative that has the rate, with it and the prediction of a model that did not see it.

    The texts are read once: folds, fits and predictions work on the numbers that the models take.
    """
    def fit(rows: DataFrame):
        model = train_rate(rows, F.col("label"), **fitting)
        return lambda others: model.transform(train_inputs(others)).select(key, "fold", "label", F.col("prediction").alias("score"))

    rated = df.withColumn("label", rate.cast("double")).where("label is not null")
    return out_of_fold(train_inputs(rated).select(key, "label", *TRAIN_INPUTS), key, fit, folds)


def comparable(vectors: DataFrame, query: Column, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors most similar to one query vector by cosine; a projection and a top-k."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, q = c(column), c("__q")
    sim = F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return once(vectors, {"__q": query}).select(key, sim.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def color_name(r: Column, g: Column, b: Column) -> Column:
    """First matching RGB rule."""
    return (F.when((r > 200) & (g < 100) & (b < 100), "red").when((r < 100) & (g < 100) & (b > 200), "blue")
            .when((r < 100) & (g > 200) & (b < 100), "green").when((r > 200) & (g > 200) & (b < 100), "yellow")
            .when((r > 200) & (g > 100) & (b < 100), "orange").when((r > 100) & (g < 100) & (b > 200), "purple")
            .when((r > 200) & (g > 200) & (b > 200), "white").when((r < 50) & (g < 50) & (b < 50), "black").otherwise("neutral"))


def visual_score() -> Column:
    """Weighted visual quality of a feature row; the component factors precede the weights."""
    parts = [(c("harmony") * 0.2, 0.2), (c("contrast") * 0.1, 0.1), (c("thirds") * 0.15, 0.15), (c("balance") * 0.15, 0.15),
             (F.when(c("product_visible"), 1.0).otherwise(0.5), 0.15), (F.lit(0.2), 0.1), (F.when(c("looking_at_camera"), 1.0).otherwise(0.8), 0.15)]
    total = F.lit(0.0)
    for s, w in parts:
        total = total + s * w
    return total


def hook_score(frames: DataFrame, creatives: DataFrame) -> DataFrame:
    """Mean vividness of the first frames; .5 where there are none."""
    vivid = c("brightness") * 0.3 + c("contrast") * 0.3 + c("saturation") * 0.4
    scores = frames.where(c("frame_no") < HOOK_FRAMES).groupBy("creative_id").agg(F.avg(vivid).alias("hook_score"))
    return creatives.select("creative_id").join(scores, "creative_id", "left").withColumn("hook_score", F.coalesce("hook_score", F.lit(0.5)))


def color_emotions(df: DataFrame, colors: str = "colors") -> DataFrame:
    """Mean emotion weights of a creative's colours; unknown colours add nothing."""
    items: list[Column] = []
    for name, emo in COLOR_EMOTIONS.items():
        items += [F.lit(name), F.array(*[F.struct(F.lit(e).alias("emotion"), F.lit(w).alias("weight")) for e, w in emo.items()])]
    table = F.create_map(*items)
    one = df.select("creative_id", F.explode(colors).alias("color"))
    emo = one.select("creative_id", F.inline(F.try_element_at(table, F.lower("color"))))
    return emo.groupBy("creative_id", "emotion").agg(F.avg("weight").alias("weight"))
