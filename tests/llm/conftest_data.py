"""Rows that the tests share."""

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} of" for i in range(30_000))
#: Null ids, texts and sources; repeated rows and ids; empty, blank, short, very long, mixed-script texts.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the old barn today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the old barn today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from the old barn today", "en", None),
    (2, "another text under an id that is taken", None, "b"),
    (None, "a text that has no id at all but is long enough for a window of words to be taken from it", "en", "b"),
    (None, "a text that has no id at all but is long enough for a window of words to be taken from it", "en", "b"),
    (None, None, None, None),
    (3, None, "en", "c"),
    (4, "", "en", "a"),
    (5, " \t\n\r\x0b\x0c ", None, "a"),
    (6, "x", "en", "a"),
    (7, LONG, "en", "long"),
    (8, "日本語のテキスト Ünïcode 😀 <|endoftext|>   done", "ja", "é"),
    (9, "you worthless idiot, you stupid moron! they said he is not an idiot.", "en", "a"),
    (-5, "negative ids are ids", "en", "b"),
    (2**62, "large ids are ids", "en", "b"),
]
CLASH = ["key", "range", "size", "taken", "word", "pos", "fp", "score", "grp", "k", "y", "t", "n", "row", "items", "component_id", "__row", "__k", "__mark", "__bs_p0", "c0", "src", "id", "hits"]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
