import random
import re

from riverlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rendered int"


def brute(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t if t is not None else 2**62, r or "", x or ""))
    lists = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: z[0])] for c, v in convs.items()}
    out = {}
    for c, own in lists.items():
        if any(o != own and o[: len(own)] == own for o in lists.values()):
            continue
        same = [d for d, o in lists.items() if o == own]
        if c == min((d for d in same if d is not None), default=c):
            out[c] = (len(own), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in own))
    return out


def rows(seed=1):
    rng = random.Random(seed)
    out, c = [], 0
    for _ in range(40):
        turns = [("user" if i % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", None, "", "long " * 30])) for i in range(rng.randint(1, 9))]
        for n in {len(turns), rng.randint(1, len(turns)), rng.randint(1, len(turns))}:
            out += [(c, i, r, x, 0) for i, (r, x) in enumerate(turns[:n])]
            c += 1
    return out + [(None, 0, "user", "alone", 0), (9000, None, None, None, 0)]


def test_only_maximal_conversations_stay(spark):
    data = rows()
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()}
    assert got == brute(data)


def test_long_conversations_are_pieced_together(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 2)
    data = rows(2)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute(data)
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_equal_turn_numbers(spark):
    """A repeated row is one more turn; turns of one number are ordered by their hashes, so conversations
    with the same turns are equal however their rows come."""
    rows = [(1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (2, 0, "user", "a", 0), (3, 5, "x", "p", 0), (3, 5, "y", "q", 0), (4, 5, "y", "q", 0), (4, 5, "x", "p", 0), (5, 0, "u", "z" * 200_000, 0)]
    odd = "conv_id long, turn long, role string, text string, k int"
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.render(spark.createDataFrame(rows, odd).repartition(3)).collect()}
    assert got == {1: (2, 1), 3: (2, 2), 5: (1, 1)}


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    assert not re.search("Python|Arrow|Pandas", chat.render(d)._jdf.queryExecution().executedPlan().toString())
    assert not re.search("Python|Arrow|Pandas", chat.prefixes(chat._turns(d, "conv_id", "turn", "role", "text"))._jdf.queryExecution().executedPlan().toString())
