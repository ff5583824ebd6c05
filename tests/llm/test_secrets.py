"""The formats of secrets are counted over all labelled values and all tokens."""

import collections
import math
import random
import string

from pyspark.sql import functions as F

from sentryframe.llm import secrets

from .builders import documents


def learned(spark, texts):
    return {r["doc_id"]: [s["value"] for s in r["learned"]] for r in secrets.find_secrets(documents(spark, texts)).collect()}


def test_values_of_any_length_are_learned(spark):
    rng = random.Random(21)
    value = lambda: "zk-" + "".join(rng.choice("GHKLMN7") for _ in range(160))
    plain = [value() for _ in range(10)]
    found = learned(spark, [f"token = {value()} and text" for _ in range(60)] + [f"see {v} here" for v in plain])
    assert [found[60 + i] for i in range(10)] == [[v] for v in plain]


def test_formats_are_counted_over_all_values_and_tokens(spark):
    rng = random.Random(22)
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    value = lambda: rng.choice([lambda: "zk" + drawn(string.digits, 8), lambda: drawn(string.ascii_lowercase, rng.randint(9, 12)), lambda: drawn("ABab01+/", 70)])()
    values = [value() for _ in range(900)]
    tokens = [drawn("aeinrst", rng.randint(8, 11)) for _ in range(2600)] + [value() for _ in range(60)]
    texts = [f"token = {v} x" for v in values] + [f"see {t} here" for t in tokens] + [f"token: {values[0]}", f"see {tokens[0]}", None, ""]
    steps, pairs = collections.Counter(), collections.Counter()
    for v in set(values):
        word = secrets.symbols(v)
        for i in range(len(word) + 1):
            steps[min(i, secrets.PLACES), word[max(0, i - secrets.ENDS):i], word[i:i + 1]] += 1
    for t in set(tokens):
        whole = f" {t} "
        for i in range(len(whole) - 1):
            pairs[whole[i], whole[i + 1]] += 1
    model = secrets.Automaton(steps)
    scores = sorted(model.score(v) for v in set(values))
    least = math.floor(scores[int(0.02 * len(scores))] * secrets.GRAINS) / secrets.GRAINS
    formats = secrets.Formats({"assign": (model, least)}, secrets.Pairs(pairs))
    found = learned(spark, texts)
    assert {t: found[len(values) + i] for i, t in enumerate(tokens)} == {t: [t] * formats.accepts(t) for t in tokens}

    seen = documents(spark, values + values + tokens).select(
        F.when(F.col("doc_id") < 2 * len(values), "assign").otherwise("").alias("kind"), F.col("text").alias("value")).distinct()
    for parts in (1, 7):
        fitted = secrets.fit(seen.repartition(parts), 0.02)
        assert fitted.models["assign"][0].cost == model.cost and fitted.models["assign"][1] == least
        assert fitted.ordinary.pair == pairs


def test_merged_states_keep_the_shares_of_all_steps():
    """A loop of digits that ends one time in four: every merged state counts all its steps."""
    steps = collections.Counter()
    rng = random.Random(23)
    for _ in range(4000):
        n = 8
        while rng.random() > 0.25:
            n += 1
        for i in range(n + 1):
            steps[min(i, secrets.PLACES), "d" * min(i, secrets.ENDS), "d" if i < n else ""] += 1
    model = secrets.Automaton(steps)
    longer = model.score("1" * 40) * 41 - model.score("1" * 39) * 40
    assert abs(math.exp(longer) - 0.75 / 10) < 0.004
    assert model.score("1" * 7) == -math.inf and model.score("1234567a") == -math.inf


class Tree:
    """The same merges on a prefix tree laid out node by node."""

    def __init__(self, words, alpha=0.05):
        self.scale = math.sqrt(0.5 * math.log(2 / alpha))
        self.next, self.count, self.stop = [{}], [{}], [0]
        for word, n in words.items():
            state = 0
            for c in word:
                self.count[state][c] = self.count[state].get(c, 0) + n
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.stop.append(0)
                state = self.next[state][c]
            self.stop[state] += n
        red, into = [0], {}
        while (blue := next(((r, c, s) for r in red for c, s in sorted(self.next[r].items()) if s not in red), None)) is not None:
            source, c, state = blue
            for r in reversed(red):
                if self.compatible(r, state):
                    self.next[source][c] = r
                    self.fold(r, state)
                    break
            else:
                red.append(state)
        number = {s: i for i, s in enumerate(red)}
        self.states = [({c: (n, number[self.next[s][c]]) for c, n in self.count[s].items()}, self.stop[s]) for s in red]

    def shares(self, s):
        n = self.stop[s] + sum(self.count[s].values())
        return n, {"": self.stop[s] / n} | {c: k / n for c, k in self.count[s].items()}

    def compatible(self, r, b):
        (n, of), (m, other) = self.shares(r), self.shares(b)
        bound = self.scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return all(abs(of.get(c, 0) - other.get(c, 0)) <= bound for c in of | other) and all(
            self.compatible(self.next[r][c], s) for c, s in self.next[b].items() if c in self.next[r])

    def fold(self, r, b):
        self.stop[r] += self.stop[b]
        for c, n in self.count[b].items():
            self.count[r][c] = self.count[r].get(c, 0) + n
            if c in self.next[r]:
                self.fold(self.next[r][c], self.next[b][c])
            else:
                self.next[r][c] = self.next[b][c]


def values_of(rng, form, n):
    drawn = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    one = {
        "hex": lambda: drawn("0123456789abcdef", rng.choice([32, 40])), "base64": lambda: drawn("ABXYacxz0189+/", 24) + "==",
        "parts": lambda: ".".join(drawn("AZax09-_", rng.randint(3, 30)) for _ in range(3)),
        "tail": lambda: drawn("ax", rng.randint(8, 12)) + rng.choice(["", drawn("019", 2)]),
        "middle": lambda: (m := rng.choice("AZ09")) + drawn("az", 9) + (drawn("09", 4) if m > "9" else drawn("AZ", 6)),
        "late": lambda: (m := rng.choice("A0")) + "-" * 12 + m,
    }[form]
    return [one() for _ in range(n)]


def test_merges_equal_those_on_a_whole_prefix_tree(monkeypatch):
    for form in ("hex", "base64", "parts", "tail", "middle", "late"):
        for n in (8, 90, 400):
            words = collections.Counter(map(secrets.symbols, values_of(random.Random(n), form, n)))
            want = Tree(words).states
            for together in (1, 1 << 16):
                monkeypatch.setattr(secrets, "TESTED", together)
                cost = secrets.Automaton({(len(w), w, ""): k for w, k in words.items()}).cost
                got = [({c: (math.exp(x) * secrets.CLASS_SIZE.get(c, 1), s) for c, (x, s) in cost[i][0].items()}, math.exp(cost[i][1])) for i in range(len(cost))]
                assert len(got) == len(want), form
                for (of, stop), (counts, stops) in zip(got, want, strict=True):
                    total = stops + sum(n for n, _ in counts.values())
                    assert {c: s for c, (_, s) in of.items()} == {c: s for c, (_, s) in counts.items()}
                    assert abs(stop - stops / total) < 1e-9 and all(abs(of[c][0] - k / total) < 1e-9 for c, (k, _) in counts.items())


def test_prefixes_that_end_alike_are_states_of_their_own(spark):
    """What stands more than two characters back, and beyond 64 characters, decides what may follow."""
    rng = random.Random(24)
    drawn = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    upper, digit = "QR", "07"
    for line in (9, 70):
        form = lambda m, end, line=line: drawn(m, 1) + "-" * line + drawn(end, 8)
        values = {form(*rng.choice([(upper, digit), (digit, upper)])) for _ in range(900)} | {form(upper, digit), form(digit, upper)}
        others = [form(upper, upper), form(digit, digit), form(upper, digit, line + 1), form(digit, upper, line - 1)]
        seen = spark.createDataFrame([("assign", v) for v in values], "kind string, value string")
        fitted = secrets.fit(seen, 0.0).models["assign"][0]
        assert all(fitted.score(v) > -math.inf for v in values) and all(fitted.score(v) == -math.inf for v in others)
