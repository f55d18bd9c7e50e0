"""A weighted finite-state grammar over word classes: small transducers, composed into one table for either direction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: Word classes, the alphabet of all transducers.
OTHER, INSULT, THREAT, TARGET, LINK, NEGATION, REPORT, MODAL, QUOTE = range(9)
CLASSES = 9
#: Classes that a clause is scored for; transducers give output at these words only.
HEADS = (INSULT, THREAT)

# General words of four languages for the closed classes.
WORDS = {
    TARGET: "you your yours yourself u ur he she him her they them their those these this that ones people du dich dir dein deine ihr euch euer er sie ihn ihnen tu te toi ton ta tes vous votre vos il elle ils elles eux tú ti tus usted ustedes vosotros él ella ellos ellas",
    LINK: "the a an is are am was were be been and or of to in for with by on at from as it which who such what so like der das ein eine einen einem ist sind bin bist war waren und oder zu in mit von auf für im am den dem des wie so le la les un une des du de est sont es suis était et ou à dans par pour avec en au aux que qui comme el los las una unos unas son eres soy era y o con por para del al como tan",
    NEGATION: "not no never neither nor without cannot nicht kein keine keinen keiner nie niemals ohne pas jamais aucun aucune sans ni nunca jamás ningún ninguna sin tampoco",
    REPORT: "said says say told tells claimed claims wrote writes quoted quotes reported reports alleged called calls word words term phrase meaning sagte sagt behauptet schrieb nannte wort begriff dit disait affirme écrit raconte mot terme dijo dice afirma escribió llamó palabra término",
    MODAL: "will gonna should must shall would going werde werden wird soll sollte wollen vais va allons doit devrait voy va vamos debe debería",
    THREAT: "kill hurt beat burn shoot stab destroy strangle murder töten umbringen schlagen verbrennen tuer frapper brûler détruire matar golpear quemar destruir",
    INSULT: "idiot idiots moron morons stupid dumb fool loser losers scum trash pathetic worthless disgusting bastard idioten dumm dummkopf trottel arschloch abschaum imbécile crétin abruti ordure connard idiota imbécil estúpido basura escoria",
}


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, class) gives the next state and a tuple of output weights."""

    start: object
    step: Callable[[object, int], tuple[object, tuple[float, ...]]]


def heads(kind: int) -> Transducer:
    """Outputs 1 at words of a class."""
    return Transducer(0, lambda _, c: (0, (float(c == kind),)))


def near(kinds: tuple[int, ...], reach: int) -> Transducer:
    """Outputs 1 at a head with a word of the classes among the `reach` words before it."""
    return Transducer(0, lambda left, c: (reach if c in kinds else max(0, left - 1), (float(c in HEADS and left > 0),)))


def within(kinds: tuple[int, ...]) -> Transducer:
    """Outputs 1 at a head with a word of the classes anywhere before it in its clause."""
    return Transducer(False, lambda seen, c: (seen or c in kinds, (float(c in HEADS and seen),)))


def reported() -> Transducer:
    """Outputs 1 at a head after a word of saying or naming: up to the end of the clause, or of what is quoted."""

    def step(state, c):
        said, marks = state
        if c == REPORT:
            return (True, 0), (0.0,)
        if c == QUOTE and said:
            return ((True, 1) if marks == 0 else (False, 0)), (0.0,)
        return state, (float(c in HEADS and said),)

    return Transducer((False, 0), step)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same classes; their outputs are joined."""

    def step(state, c):
        (x, out), (y, more) = a.step(state[0], c), b.step(state[1], c)
        return (x, y), out + more

    return Transducer((a.start, b.start), step)


class Machine:
    """A transducer as tables: to[state][class] and out[state][class]."""

    def __init__(self, of: Transducer):
        states, rows, outs, at = {of.start: 0}, [], [], [of.start]
        for state in at:
            row, out = [], []
            for c in range(CLASSES):
                following, weights = of.step(state, c)
                if following not in states:
                    states[following] = len(states)
                    at.append(following)
                row.append(states[following])
                out.append(weights)
            rows.append(row)
            outs.append(out)
        self.to, self.out = rows, outs

    def run(self, classes: list[int]) -> dict[int, tuple[float, ...]]:
        """position -> weights of each head of a clause."""
        state, found = 0, {}
        for i, c in enumerate(classes):
            if c in HEADS:
                found[i] = self.out[state][c]
            state = self.to[state][c]
        return found


#: The transducers that read a clause forwards, and those that read it backwards as well.
FORWARD = {"insult": heads(INSULT), "threat": heads(THREAT), "target": near((TARGET,), 3), "frame": within((TARGET, LINK)), "pile": within((INSULT,)), "modal": near((MODAL,), 3), "negated": near((NEGATION,), 3), "reported": reported()}
BACKWARD = {"target": near((TARGET,), 3), "frame": within((TARGET, LINK)), "pile": within((INSULT,))}


def composed(parts: dict[str, Transducer]) -> Machine:
    first, *rest = parts.values()
    for part in rest:
        first = compose(first, part)
    return Machine(first)


#: What a head may be in its clause; one of these, the first that holds, or nothing.
PATTERNS = ("threat", "direct", "framed", "pile")
#: What is left of a head's weight under negation, and in reported speech.
NEGATED, REPORTED = 0.1, 0.2


class Grammar:
    """Finds the heads of a clause that a pattern matches.

    threat: a threat verb with a modal shortly before and a target on either side; direct: an insult with a target on
    either side; framed: an insult in a clause that has words which build clauses; pile: an insult
    in a clause that has another one.
    A word that stands in no such pattern, as in a list of words, is no match.
    """

    def __init__(self):
        self.forward, self.backward = composed(FORWARD), composed(BACKWARD)

    def matches(self, classes: list[int]) -> list[tuple[int, str, float]]:
        """(position, pattern, what is left of the weight) of each match."""
        if not any(c in HEADS for c in classes):
            return []
        last, out = len(classes) - 1, []
        before, after = self.forward.run(classes), self.backward.run(classes[::-1])
        for i, weights in before.items():
            left, right = dict(zip(FORWARD, weights)), dict(zip(BACKWARD, after[last - i]))
            target, frame, pile = (left[k] or right[k] for k in ("target", "frame", "pile"))
            if left["threat"]:
                pattern = "threat" if left["modal"] and target else None
            else:
                pattern = "direct" if target else "framed" if frame else "pile" if pile else None
            if pattern:
                out.append((i, pattern, (NEGATED if left["negated"] else 1.0) * (REPORTED if left["reported"] else 1.0)))
        return out
