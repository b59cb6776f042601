"""Coding a column of answers in Spark, and what is counted from it."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallywright.functions.coding import SEED, Coder, Lexicon
from tallywright.functions.textprep import masked_numbers, normalise
from tallywright.functions.triggers import Triggers, of_topic

THEME = "struct<code_id:int,theme:string,net:string,subnet:string,topic:string,polarity:string,confidence:double>"
CODED = f"text string, themes array<{THEME}>, sentiment string, score double, confidence double, needs_review boolean, reasons array<string>"


def coded(df: DataFrame, column: str, codeframe: dict, lexicon: Lexicon = SEED, review: bool = True, feedback: DataFrame | None = None, salt: str = "") -> DataFrame:
    """``df`` with ``coded``: the record of each answer. Ids and other columns stay with their answers.

    Numbers are masked by built-in expressions, names and codes come from one Arrow-batched function.
    Exact corrections in ``feedback`` (text_key, themes, sentiment) win over the coder.
    """
    sent = df.sparkSession.sparkContext.broadcast((codeframe, lexicon, review))

    @F.pandas_udf(CODED)
    def run(batches: pd.Series) -> pd.DataFrame:
        frame, words, queue = sent.value
        coder = _coder(frame, words, queue)
        return pd.DataFrame([coder.code(t) for t in batches], columns=["text", "themes", "sentiment", "score", "confidence", "needs_review", "reasons"])

    out = df.withColumn("coded", run(masked_numbers(F.col(column))))
    if feedback is None:
        return out
    fixed = feedback.select("text_key", F.col("themes").alias("fixed_themes"), F.col("sentiment").alias("fixed_sentiment"))
    out = out.withColumn("_key", text_key(F.col("coded.text"), salt)).join(fixed, F.col("_key") == F.col("text_key"), "left")
    right = F.struct(F.col("coded.text").alias("text"), F.col("fixed_themes").alias("themes"), F.col("fixed_sentiment").alias("sentiment"), F.lit(0.0).alias("score"), F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_review"), F.array(F.lit("correction")).alias("reasons"))
    return out.withColumn("coded", F.when(F.col("text_key").isNotNull(), right).otherwise(F.col("coded"))).drop("_key", "text_key", "fixed_themes", "fixed_sentiment")


_CODERS: dict[int, Coder] = {}


def _coder(frame: dict, words: Lexicon, queue: bool) -> Coder:
    key = id(frame)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(frame, replace(words), queue)
    return _CODERS[key]


def text_key(c: Column, salt: str = "") -> Column:
    """A keyed hash of the normalised text, so stored corrections never hold answers."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hmac.new(salt.encode(), normalise(t or "").strip().encode(), hashlib.sha256).hexdigest())

    return run(c)


def theme_frequencies(df: DataFrame, citations: int = 5, order: str = "response_id") -> DataFrame:
    """theme, code_id, n, prevalence (percent of answers) and up to ``citations`` first texts by ``order``."""
    total = df.agg(F.count("*").alias("total"))
    t = df.select(F.col(order).alias("o"), F.col("coded.text").alias("text"), F.explode("coded.themes").alias("t")).select("o", "text", "t.theme", "t.code_id")
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("theme").orderBy("o"))).filter(F.col("r") <= citations).groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s["text"]).alias("quotes"))
    n = t.groupBy("theme", "code_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return n.join(first, "theme").select("theme", "code_id", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("prevalence"), "quotes")


def sentiment_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("coded.sentiment").alias("sentiment")).agg(F.count("*").alias("n"))


def counters(df: DataFrame, name: str = "coder") -> tuple[DataFrame, Observation]:
    """``df`` and counts that fill while it is first run: answers, those to review, corrections, special answers, sentiments.

    Read them by ``Observation.get`` after an action on the returned frame; they cost no extra pass.
    """
    seen = Observation(name)
    some = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    why = lambda r: F.array_contains("coded.reasons", r)
    special = [some(why(f"special:{k}")).alias(f"special_{k}") for k in ("none", "dont_know", "needs_review")]
    moods = [some(F.col("coded.sentiment") == k).alias(f"sentiment_{k}") for k in ("pos", "neg", "neutral", "mixed")]
    return df.observe(seen, F.count("*").alias("answers"), some(F.col("coded.needs_review")).alias("needs_review"), some(why("correction")).alias("corrections"), *special, *moods), seen


def review_queue(df: DataFrame, order: str = "response_id", most: int = 200) -> DataFrame:
    """The first answers that need a person."""
    return df.filter("coded.needs_review").orderBy(order).select(order, "coded.*").limit(most)


def corrected(queue: DataFrame, corrections: DataFrame, key: str = "response_id") -> DataFrame:
    """Records with themes and sentiment of ``corrections`` (key, themes, sentiment) where there are any."""
    c = corrections.select(F.col(key).alias("_k"), F.col("themes").alias("_t"), F.col("sentiment").alias("_s"))
    new = F.col("coded").withField("themes", F.col("_t")).withField("sentiment", F.col("_s")).withField("needs_review", F.lit(False)).withField("confidence", F.lit(1.0))
    return queue.join(c, F.col(key) == F.col("_k"), "left").withColumn("coded", F.when(F.col("_k").isNotNull(), new).otherwise(F.col("coded"))).drop("_k", "_t", "_s")


def hierarchy(df: DataFrame, respondent: str, net: str, subnet: str, leaf: str, banner: str | None = None) -> DataFrame:
    """Respondents by net, subnet and leaf, each level without double counting, by banner column and in total.

    One row per level and column: level (1 to 3), net, subnet, leaf, banner (null: total), n, pct of the
    column's respondents. Rows without a net count among the respondents only. Grouping sets count distinct respondents, so a net's number is that of a union.
    """
    b = F.col(banner).cast("string") if banner else F.lit(None).cast("string")
    t = df.select(F.col(respondent).alias("r"), F.col(net).alias("net"), F.col(subnet).alias("subnet"), F.col(leaf).alias("leaf"), b.alias("banner"))
    levels = [("net", "subnet", "leaf"), ("net", "subnet"), ("net",)]
    sets = [*levels, *([(*x, "banner") for x in levels] if banner else [])]
    counted = df.sparkSession.sql(f"""
        SELECT CASE WHEN grouping(leaf) = 0 THEN 3 WHEN grouping(subnet) = 0 THEN 2 ELSE 1 END AS level, net, subnet, leaf, banner, grouping(banner) AS is_total, count(DISTINCT r) AS n
        FROM {{rows}} GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(x) + ")" for x in sets)}{"" if banner else ", (net, subnet, leaf, banner)"})""", rows=t).filter("net is not null")
    if not banner:
        counted = counted.filter("is_total = 1")
    base = t.groupBy("banner").agg(F.count_distinct("r").alias("base")).select(F.col("banner").alias("b"), F.lit(0).alias("z"), "base").union(t.agg(F.count_distinct("r")).select(F.lit(None).cast("string"), F.lit(1), F.col("count(DISTINCT r)"))) if banner else t.agg(F.count_distinct("r").alias("base")).select(F.lit(None).cast("string").alias("b"), F.lit(1).alias("z"), "base")
    out = counted.join(F.broadcast(base), F.expr("banner <=> b and is_total = z"))
    return out.select("level", "net", "subnet", "leaf", "banner", "n", (F.col("n") * 100.0 / F.col("base")).alias("pct"))


def leaf_rows(df: DataFrame, respondent: str, codeframe: dict, keep: list[str] = ()) -> DataFrame:
    """(respondent, net, subnet, leaf, *keep) of each leaf an answer in ``coded`` belongs to, for ``hierarchy``.

    A leaf is a code of a topic. It is met by its code, by a theme that equals its label or holds it or is held
    by it, by one of the topic's words or quotes in the text, or by its label in the text (four letters at
    least). An answer without a leaf has one row without a net, so it stays among the respondents.
    """
    leaves = [(t.get("net") or "General", t.get("subnet") or "General", c["label"], c["code_id"], i) for i, t in enumerate(codeframe["topics"]) for c in t["codes"].values()]
    words = [(w, n) for n, leaf in enumerate(leaves) for w in of_topic(codeframe["topics"][leaf[4]])]
    labels = [leaf[2].strip().lower() for leaf in leaves]
    sent = df.sparkSession.sparkContext.broadcast((words, labels, [leaf[3] for leaf in leaves]))

    @F.pandas_udf("array<int>")
    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        words, labels, codes = sent.value
        anywhere, named = Triggers(words, whole=False), Triggers([(w, n) for n, w in enumerate(labels)], whole=False, least=4)
        by_code: dict[int, set[int]] = {}
        for n, code in enumerate(codes):
            by_code.setdefault(code, set()).add(n)
        for coded in batches:
            alike: dict[str, set[int]] = {}
            out = []
            for text, themes in zip(coded["text"], coded["themes"]):
                low = (text or "").lower()
                found = anywhere.owners(low) | named.owners(low)
                for theme in themes if themes is not None else ():
                    name = (theme["theme"] or "").strip().lower()
                    if name not in alike:
                        alike[name] = {n for n, label in enumerate(labels) if label in name or name in label} if name else set()
                    found |= alike[name] | by_code.get(theme["code_id"], set())
                out.append(sorted(found))
            yield pd.Series(out)

    rows = df.select(F.col(respondent), F.explode_outer(met(F.struct("coded.text", "coded.themes"))).alias("_leaf"), *keep)
    table = df.sparkSession.createDataFrame([(n, *leaf[:3]) for n, leaf in enumerate(leaves)], "_n int, net string, subnet string, leaf string")
    return rows.join(F.broadcast(table), F.col("_leaf") == F.col("_n"), "left").select(respondent, "net", "subnet", "leaf", *keep)  # a codeframe's codes


def stratified_split(df: DataFrame, strata: list[str], key: str, share: float = 0.7, seed: str = "split") -> DataFrame:
    """``df`` with ``part`` (train, test): in each stratum the first round(n * share) rows by salted SHA-256."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*strata)
    n = F.count("*").over(w)
    return df.withColumn("part", F.when(F.row_number().over(w.orderBy(h, key)) <= F.round(n * share), "train").otherwise("test"))


# --- learning from corrections ----------------------------------------------


def naive_bayes(examples: DataFrame, tokens: str, label: str, least: int = 20) -> tuple[DataFrame, DataFrame] | None:
    """Laplace-smoothed log likelihoods (label, token, ll, unseen) and priors; None below ``least`` examples."""
    n = examples.count()
    if n < least:
        return None
    words = examples.select(F.col(label).alias("label"), F.explode(F.array_distinct(tokens)).alias("token"))
    vocabulary = words.agg(F.count_distinct("token").alias("v"))
    per = words.groupBy("label").agg(F.count("*").alias("t"))
    ll = words.groupBy("label", "token").agg(F.count("*").alias("c")).join(per, "label").crossJoin(F.broadcast(vocabulary))  # one row
    ll = ll.select("label", "token", F.log((F.col("c") + 1) / (F.col("t") + F.col("v"))).alias("ll"))
    priors = examples.groupBy(F.col(label).alias("label")).agg(F.log(F.count("*") / n).alias("prior")).join(per, "label", "left").crossJoin(F.broadcast(vocabulary))
    return ll, priors.select("label", "prior", F.log(1 / (F.coalesce("t", F.lit(0)) + F.col("v"))).alias("unseen"))


def naive_bayes_predict(df: DataFrame, key: str, tokens: str, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, label, probability) of the best label; labels are few, so each row meets each of them."""
    ll, priors = model
    words = df.select(F.col(key).alias("k"), F.explode_outer(F.array_distinct(tokens)).alias("token"))
    labelled = words.crossJoin(F.broadcast(priors)).join(ll, ["label", "token"], "left")  # labels of one codeframe
    score = labelled.groupBy("k", "label").agg((F.first("prior") + F.sum(F.when(F.col("token").isNotNull(), F.coalesce("ll", "unseen")).otherwise(0.0))).alias("s"))
    top = F.max("s").over(Window.partitionBy("k"))
    best = score.withColumn("probability", F.exp(F.col("s") - top)).withColumn("z", F.sum("probability").over(Window.partitionBy("k"))).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "label")))
    return best.filter("r = 1").select(F.col("k").alias(key), "label", (F.col("probability") / F.col("z")).alias("probability"))


DIMENSION = 256


def hashed(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Signed hashing of words and character trigrams, of unit length."""
    out = np.zeros(dimension)
    words = normalise(text).split()
    for piece in words + [f"#{w}#"[i : i + 3] for w in words for i in range(len(w))]:
        h = hashlib.md5(piece.encode()).digest()
        out[int.from_bytes(h[:4], "little") % dimension] += 1 if h[4] & 1 else -1
    n = np.linalg.norm(out)
    return out / n if n else out


class PassiveAggressive:
    """Online multi-class learner over hashed texts, with snapshots and a guard against poisoning."""

    def __init__(self, labels: list[str], aggressiveness: float = 1.0, most_step: float = 2.5, most_texts: int = 500, snapshots: int = 20):
        self.labels, self.w, self.c = list(labels), np.zeros((len(labels), DIMENSION)), aggressiveness
        self.most_step, self.most_texts, self.most_snapshots, self.history = most_step, most_texts, snapshots, []

    def update(self, texts: list[str], labels: list[str]) -> float:
        """One pass; undone with an error if it is too large or moves the weights too far."""
        if len(texts) > self.most_texts:
            raise ValueError(f"at most {self.most_texts} texts at a time")
        before = self.w.copy()
        for text, label in zip(texts, labels):
            x, right = hashed(text), self.labels.index(label)
            scores = self.w @ x
            scores[right] -= 1e9
            rival = int(scores.argmax())
            loss = max(0.0, 1 - self.w[right] @ x + self.w[rival] @ x)
            step = loss / (2 * (x @ x) + 1 / (2 * self.c)) if loss else 0.0
            self.w[right] += step * x
            self.w[rival] -= step * x
        moved = float(np.linalg.norm(self.w - before))
        if moved > self.most_step * max(1.0, len(texts) ** 0.5):
            self.w = before
            raise ValueError("the update moves the model too far")
        self.history = [*self.history, before][-self.most_snapshots :]
        return moved

    def rollback(self) -> None:
        if self.history:
            self.w = self.history.pop()

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        """label, confidence, margin to the next label, needs_review (margin below .25 or confidence below .5)."""
        s = np.stack([hashed(t or "") for t in texts]) @ self.w.T if len(texts) else np.zeros((0, len(self.labels)))
        p = np.exp(s - s.max(1, keepdims=True)) if len(s) else s
        p = p / p.sum(1, keepdims=True) if len(p) else p
        order = np.sort(p, axis=1)
        margin = order[:, -1] - order[:, -2] if p.shape[1] > 1 else order[:, -1]
        return pd.DataFrame({"label": [self.labels[i] for i in p.argmax(1)], "confidence": order[:, -1], "margin": margin, "needs_review": (margin < 0.25) | (order[:, -1] < 0.5)})

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``predicted``; the weights are a few hundred kilobytes and are broadcast."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("label string, confidence double, margin double, needs_review boolean")
        def run(s: pd.Series) -> pd.DataFrame:
            return sent.value.predict(s)

        return df.withColumn("predicted", run(column))

    def coded(self, df: DataFrame, codeframe: dict) -> DataFrame:
        """``df``, which has ``coded``, with ``learned``: codes by whole words first, by the predicted label else.

        Each topic with one of its words or quotes in the text gives the code of the answer's sentiment, or all
        its codes if it has none for it. Where no topic does, the predicted label's topic (by subnet, net or id)
        gives its code, and where there is none, the label is the theme. What the prediction doubts or has no code goes
        to review. A blank answer has no theme.
        """
        sent = df.sparkSession.sparkContext.broadcast((self, codeframe["topics"]))

        @F.pandas_udf("label string, themes array<string>, codes array<int>, confidence double, margin double, needs_review boolean")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            learner, topics = sent.value
            words = Triggers([(w, n) for n, t in enumerate(topics) for w in of_topic(t)], whole=True)
            by_name = {name: t["codes"] for t in reversed(topics) if (name := t.get("subnet") or t.get("net") or t["id"])}
            for text, sentiment in batches:
                out = learner.predict(text)
                rows = []
                for answer, mood, label, sure, margin, doubt in zip(text, sentiment, *(out[c] for c in out)):
                    low, codes = (answer or "").lower(), []
                    if not low.strip():
                        rows.append((None, [], [], 0.0, 0.0, True))
                        continue
                    for n in sorted(words.owners(low)):
                        of = topics[n]["codes"]
                        codes += [of[mood]] if mood in ("pos", "neg") and mood in of else of.values()
                    if not codes and label in by_name:
                        codes = [by_name[label].get(mood) or next(iter(by_name[label].values()))]
                    themes = dict.fromkeys([c["label"] for c in codes] or [label])
                    rows.append((label, list(themes), list(dict.fromkeys(c["code_id"] for c in codes)), sure, margin, doubt or not codes))
                yield pd.DataFrame(rows, columns=["label", "themes", "codes", "confidence", "margin", "needs_review"])

        return df.withColumn("learned", run(F.col("coded.text"), F.col("coded.sentiment")))


def hashed_all(texts: list[str]) -> np.ndarray:
    return np.stack([hashed(t) for t in texts])


class SoftmaxHead:
    """Multinomial logistic regression over embedded texts, fitted in Spark and applied in Arrow batches."""

    MOST_LABELS = 100

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, embed: Callable[[list[str]], np.ndarray]):
        self.labels, self.weights, self.bias, self.embed = labels, weights, bias, embed

    @classmethod
    def fit(cls, examples: DataFrame, column: str, label: str, embed: Callable[[list[str]], np.ndarray] = hashed_all, ridge: float = 1e-3) -> SoftmaxHead:
        """Fit to the rows with a label; a null text is empty. ``embed`` turns texts into rows of numbers and must be picklable."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        rows = examples.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("name"), F.col(column).alias("t"))
        labels = sorted(r.name for r in rows.select("name").distinct().limit(cls.MOST_LABELS + 1).collect())
        if not 2 <= len(labels) <= cls.MOST_LABELS:
            raise ValueError(f"a head needs 2 to {cls.MOST_LABELS} labels")

        @F.pandas_udf("array<double>")
        def embedded(s: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(embed([t or "" for t in s]), float)) if len(s) else [], dtype=object)

        number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("name")) - 1
        model = LogisticRegression(family="multinomial", regParam=ridge, standardization=False).fit(rows.select(array_to_vector(embedded("t")).alias("features"), number.cast("double").alias("label")))
        return cls(labels, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), embed)

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``head``: the likeliest label and its probability."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("label string, confidence double")
        def run(s: pd.Series) -> pd.DataFrame:
            me = sent.value
            if not len(s):
                return pd.DataFrame({"label": [], "confidence": []})
            z = np.asarray(me.embed([t or "" for t in s]), float) @ me.weights.T + me.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            return pd.DataFrame({"label": [me.labels[i] for i in p.argmax(1)], "confidence": p.max(1)})

        return df.withColumn("head", run(column))
