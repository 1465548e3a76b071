"""The toxicity grammar read straight off its definition, word by word, without transducers."""

import re

TOKEN, MARK = r"[0-9A-Za-z\x80-\U0010ffff]+", r'[,:()\[\]"]'


def sentences(text):
    text = re.sub("[«»“”„]", '"', text or "")
    text = re.sub("[‘’]", "'", text)
    for sentence in re.split(r"[.;!?\n\r]", text):
        yield re.findall(f"{TOKEN}|{MARK}", sentence)


def sums(text, classify):
    """plain, targeted, negated, reported, threat, excused. classify(token): (class name, weight)."""
    out = [0.0] * 6
    for parts in sentences(text):
        clauses, kinds = [[]], []
        for p in parts:
            if re.fullmatch(MARK, p):
                clauses.append([])
            else:
                clauses[-1].append(len(kinds))
                kinds.append(classify(p))
        clauses = [c for c in clauses if c]
        fronted = len(clauses) > 1 and all(kinds[i][0] == "target" for i in clauses[0])
        for n, clause in enumerate(clauses):
            for place, i in enumerate(clause):
                name, weight = kinds[i]
                negated = any(kinds[j][0] == "negation" for j in clause[max(0, place - 3) : place])
                reported = any(k[0] == "report" for k in kinds[:i])
                if name == "insult":
                    targeted = any(kinds[j][0] == "target" for j in clause)
                    out[3 if reported else 2 if negated else 1 if targeted else 0] += weight
                if name == "threat":
                    aimed = any(kinds[j][0] == "target" for j in clause[place + 1 : place + 4])
                    if aimed or (fronted and n > 0 and i == len(kinds) - 1):
                        out[5 if reported or negated else 4] += weight
    return out
