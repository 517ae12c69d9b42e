from locusframe.llm import secrets


def test_opaque_inside_a_base_span_is_dropped_in_texts_of_any_number_of_secrets():
    for n in (64, 65, 300):
        lines = [f"user: name{i} token: x.wJalrXUtnFEMIK7MDENGbPxRfiCY{i:04}" for i in range(n)]
        base, added = secrets.find("\n".join(lines))
        assert len(base) == n and [secrets.KINDS[s[2]] for s in added] == ["account"] * n


def test_containment_equals_all_pairs():
    import random

    rng = random.Random(5)
    for n in (0, 1, 70, 200):
        taken = {(a := rng.randrange(3000), a + rng.randrange(1, 200)) for _ in range(n)}
        spans = [(a := rng.randrange(3000), a + rng.randrange(1, 60), 5) for _ in range(100)]
        assert secrets._contained(spans, taken) == [any(a <= s[0] and s[1] <= b for a, b in taken) for s in spans]


def test_long_weak_values_are_whole():
    for value, kind in (("postgres://db/" + "a/" * 400, "endpoint"), ("host: " + "h." * 300, "endpoint"), ("user: " + "u." * 200, "account")):
        text = f"{value} password=hunter2hunter2"
        start = 6 if kind == "account" else 0
        assert (start, len(value), secrets.KINDS.index(kind)) in secrets.find(text)[1]
