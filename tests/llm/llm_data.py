"""Small tables of awkward rows."""

import random

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, spans string, size string, "
    "score string, ids string, media string, key string, place string, component_id string, fp string"
)


def letters(seed, words, width=7):
    draw = random.Random(seed)
    return " ".join(
        "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, width))) for _ in range(words)
    )


def messy_documents():
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, other alphabets."""
    passage, tail = letters(1, 90), letters(2, 40)
    texts = [
        (0, f"{letters(3, 60)}. {passage} {tail}", "en", "b"),
        (1, f"{letters(4, 30)}! {passage}. {letters(5, 80)}", "de", "a"),
        (1, f"{letters(4, 30)}! {passage}. {letters(5, 80)}", "de", "a"),
        (2, None, None, None),
        (3, "", "en", None),
        (None, f"no id. {passage}", None, "a"),
        (None, "no id either", "en", "c"),
        (4, " \n\t \x0b", "en", "a"),
        (5, f"{letters(3, 60)}. {passage} {tail}", "en", "c"),
        (6, letters(6, 9000), "en", "b"),
        (7, "x" * 3000 + "\n" + "!" * 700 + " " * 900, "fr", "b"),
        (8, "Grüße, мир 你好 🙂 \x1c\x85 ½² İ ǅ 'll we'RE can't 12345", "de", "ü"),
        (9, f"{letters(3, 60)}. {passage} {tail} again", "en", "a"),
        (10, letters(7, 20) + " mail a.b@c.example or 10.0.0.256 or 10.0.0.255 +1 (606) 555-7814", "en", "a"),
        (20, "one two", "en", ""),
        (21, "One  TWO", "en", "b"),
    ]
    return [(i, t, la, s, None if t is None else len(t), *["x"] * 9) for i, t, la, s in texts]
