"""Small tables with nulls, empty, long and repeated texts, ties, and columns
whose names clash with those the operators use inside."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, fp long, words string"


def documents():
    rnd = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("tha", "ion", "ere", "öst", "que", "an") for b in ("ta", "lo", "né", "r", "sh")]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    passage, near = prose(60), prose(200)
    texts = [
        None, "", "", " \t\n\x0b\x0c\r ", "one two", "One Two", "a\x1cb\x85c d", prose(30),
        passage, prose(50) + " " + passage + "\n" + prose(20), prose(10) + "\n" + passage,
        near, near, near.upper(), near.replace("tha", "Tha"), near + " tail", near + " tail.",
        "ab " * 300, ("x" * 3000) + " " + prose(3000), prose(40) + "\n" + "a line of some length here\n" + prose(40),
        "a line of some length here\n" + prose(30), "a line of some lenght here\n" + prose(30),
        "A line of some length here\n" + prose(30), "a line of some length her\nshort\nshort\n" + prose(30),
        prose(25) + " $$$ ### %%% &&& " * 40, ("SHOUT!! " + prose(2).upper() + "!! ") * 40,
        "mail me.x@host-1.example.com.y_z@a.bc or 1.2.3.4.5.6.7.8, 256.1.1.1 and 010.001.0.255 " + prose(20),
        "card 4111 1111 1111 1111 or 4111111111111111 4012888888881881 not 4111111111111112 " + prose(20),
        "call +1 (743) 555-3824 or +49 30 1234567 4111-1111-1111-1111 x+1 2 " + prose(20),
        "<|endoftext|> İstanbul Σ ²½ don't é 日本語 \U0001f44d​", "﻿▁▁ a▁b  c\x00d", prose(5000),
    ]
    rows = [(i * 7 % 101, t, "en", "s", None if t is None else len(t), 1, 2, 3, "w") for i, t in enumerate(texts)]
    return rows + [rows[9], (None, prose(40), None, None, None, None, None, None, None)]


def frame(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
