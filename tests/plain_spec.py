"""The chunkers again, in plain Python, one text at a time: what the columns are held to."""

import re


def fixed(text, size, overlap):
    z, v = 4 * size, 4 * overlap
    out, at = [], 0
    while True:
        end = min(at + z, len(text))
        out.append((text[at:end], at, end, end - at))
        if end == len(text):
            return out
        at += z - v


def _pack(units, size, overlap, joiner, tail_of):
    z, v = 4 * size, 4 * overlap
    out, held, counted, pos = [], [], 0, 0
    for unit in units:
        if held and counted + len(unit) > z:
            chunk = joiner.join(held)
            out.append((chunk, pos, pos + len(chunk), len(held)))
            held = tail_of(held, v)
            width = len(joiner.join(held))
            pos += len(chunk) - width
            counted = width
        held = [*held, unit]
        counted += len(unit)
    if held:
        chunk = joiner.join(held)
        out.append((chunk, pos, pos + len(chunk), len(held)))
    return out


def _units(text, pattern):
    return [p.strip() for p in re.split(pattern, text) if p.strip()]


def sentence(text, size, overlap):
    def tail(held, v):
        keep = 0
        while keep < len(held) and len(" ".join(held[len(held) - keep :])) + len(held[-keep - 1]) < v:
            keep += 1
        return held[len(held) - keep :]

    return _pack(_units(text, r"(?<=[.!?])\s+"), size, overlap, " ", tail)


def paragraph(text, size, overlap):
    return _pack(_units(text, r"\n\s*\n"), size, overlap, "\n\n", lambda held, v: held[-1:] if len(held[-1]) < v else [])


def recursive(text, size, overlap):
    z, stride = 4 * size, 4 * (size - overlap)

    def parts_of(part, seps):
        if not seps:
            return [part[i : i + z] for i in range(0, len(part), stride)]
        sep, done, held, counted = seps[0], [], [], 0
        for p in part.split(sep):
            if held and counted + len(p) > z:
                done.append(sep.join(held))
                held, counted = [], 0
            if len(p) > z:
                done += parts_of(p, seps[1:])
            else:
                held.append(p)
                counted += len(p) + len(sep)
        return [*done, sep.join(held)] if held else done

    out, pos = [], 0
    for part in parts_of(text, ["\n\n", "\n", ". ", " "]):
        at = text.find(part, pos)
        at = pos if at < 0 else at
        pos = at + len(part)
        out.append((part, at, pos, None))
    return out


def token(text, size, overlap):
    tokens = re.findall(r"\s*\S+|\s+\Z", text)
    out, first = [], 0
    while tokens:
        own = tokens[first : first + size]
        at = len("".join(tokens[:first]))
        out.append(("".join(own), at, at + len("".join(own)), len(own)))
        if first + size >= len(tokens):
            break
        first += size - overlap
    return out


ALL = {"fixed_chars": fixed, "sentence": sentence, "paragraph": paragraph, "recursive": recursive, "token": token}
