"""Python scorers as a user would bring them, for the tests of the UDF column."""

from collections.abc import Sequence

import pandas as pd

from exposurelab.operators.text import Scorer


class KeywordScorer:
    """A small scorer: the label with more keywords wins, ties are positive."""

    def __init__(self, negative: Sequence[str], positive: Sequence[str]):
        self.negative, self.positive = frozenset(negative), frozenset(positive)

    def __call__(self) -> Scorer:
        return self.score

    def score(self, texts: pd.Series) -> pd.DataFrame:
        found = texts.fillna("").str.lower().str.findall(r"[^\W\d_]+")
        bad = found.map(lambda ws: sum(w in self.negative for w in ws))
        good = found.map(lambda ws: sum(w in self.positive for w in ws))
        worse = bad > good
        share = (1.0 + bad.where(worse, good)) / (2.0 + bad + good)
        return pd.DataFrame({"label": worse.map({True: "NEGATIVE", False: "POSITIVE"}), "score": share})


class LinearScorer:
    """Independent logistic scores from word weights, one column per label."""

    def __init__(self, weights: dict[str, Sequence[float]], bias: Sequence[float], names: Sequence[str]):
        self.weights, self.bias, self.names = weights, list(bias), list(names)

    def __call__(self) -> Scorer:
        return self.score

    def score(self, texts: pd.Series) -> pd.DataFrame:
        import numpy as np

        k = len(self.names)
        out = np.zeros((len(texts), k))
        for row, words in enumerate(texts.fillna("").str.lower().str.findall(r"[^\W\d_]+")):
            hits = [self.weights[w] for w in words if w in self.weights]
            out[row] = np.mean(hits, axis=0) if hits else 0.0
        return pd.DataFrame(1 / (1 + np.exp(-(out + np.array(self.bias)))), columns=self.names)
