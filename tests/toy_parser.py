"""A toy format for the paged source: pages are split by form feeds. What was read is noted beside the file."""


def pages(path, first, last):
    with open(path, encoding="utf-8") as f:
        every = f.read().split("\f")
    with open(path + ".asked", "a", encoding="utf-8") as note:
        note.write(f"{first}-{last}\n")
    for i, text in enumerate(every, 1):
        if i >= first and (last is None or i <= last):
            yield i, text


def count(path):
    with open(path, encoding="utf-8") as f:
        return f.read().count("\f") + 1
