#: Cases that every operator over documents must live with: nulls, empty and blank texts, ties, repeated rows, a long text, clashing columns.
AWKWARD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, "a text without an id " * 30, "en", "a", 1), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "same text here " * 40, "en", "b", 9), (5, "same text here " * 40, "en", "b", 9), (6, "same text here " * 40, "de", "b", 9),
    (7, "long " + " ".join("word" + "".join("abcdefghij"[int(d)] for d in str(i)) for i in range(2000)), "en", "c", 9), (8, "nul \x00 and ▁ and 🙂 and   x" * 20, "fr", "c", 9), (5, "another text of the same id " * 25, "en", "b", 9), (None, None, None, None, None),
]
