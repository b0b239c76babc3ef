"""Trains the trees of mail.py: python -m kelpmill.llm.train_mail SF_DIR. At most SAMPLE mails, in hash order;
half as many lines again are these with features exchanged, labelled by the same rules."""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa

from kelpmill.llm import mail, trees
from kelpmill.session import get_spark, table

SAMPLE = 3000


def main(sf_dir: str) -> None:
    spark = get_spark(8, "train-mail")
    rows = mail.described(table(spark, sf_dir, "brain_documents"), table(spark, sf_dir, "gmail_messages"))
    sample = rows.selectExpr("*", "xxhash64(record_id) AS h").orderBy("h").limit(SAMPLE).drop("h").toArrow()
    x = np.concatenate([f for b in sample.to_batches() for _, _, f in mail.rows_of(b)])
    rng = np.random.default_rng(1)
    more = x[rng.integers(0, len(x), len(x) // 2)]  # a small corpus knows no other senders; places and kinds of lines mix freely
    more[rng.random(len(more)) < 0.7, mail.FEATURES.index("senders") : mail.FEATURES.index("repeated") + 1] = 0
    for column in range(x.shape[1]):
        swap = rng.random(len(more)) < 0.06
        more[swap, column] = rng.permutation(x[:, column])[: swap.sum()]
    x = np.concatenate([x, more])
    y = np.array([mail.rule_label(dict(zip(mail.FEATURES, r))) for r in x.tolist()], float)
    half = np.arange(len(x)) % 5 > 0
    model = trees.fit(x[half], y[half], trees=120)
    held = trees.score(model, x[~half]) >= 0.5
    print(len(x), "lines,", y.mean(), "new, held-out agreement with the rules", (held == y[~half]).mean())
    with open(mail.MODEL, "w") as f:
        json.dump({"base": model["base"], "trees": [{"feature": t["feature"], "cut": [round(c, 5) for c in t["cut"]], "value": [round(v, 5) for v in t["value"]]} for t in model["trees"]]}, f)


if __name__ == "__main__":
    main(sys.argv[1])
