"""A gated recurrent unit over words in numpy, with a softmax factored into classes and the words of a class.

P(word | past) = P(class | state) * P(word | class). The words of head classes have a softmax of their own, which sees the
state; those of tail classes follow their counts, which the caller adds. Inputs are looked up as gate sums, so
an embedding and the gates' input matrix are one table. Weights are bounded so that no exponential overflows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 24
CLASS_WORDS = 64
WINDOW = 48
MOST_LANES = 512
#: Training uses as many lanes as leave a pass about so many steps, at most TRAINING_LANES.
TRAINING_STEPS = 64
TRAINING_LANES = 256
LEARNING_RATE = 0.01
_CLIP = {"gates": 6.0, "recurrent": 3.0, "class_weights": 2.5, "class_bias": 12.0, "word_weights": 2.5, "word_bias": 12.0}


@dataclass
class Vocabulary:
    """For each token id: its class, its place in a head class (-1 in tail classes), and its row of the input table."""

    classes: np.ndarray
    places: np.ndarray
    inputs: np.ndarray
    n_classes: int
    n_head: int
    n_inputs: int  # the last row stands for the start of a document


def new_weights(vocabulary: Vocabulary, class_shares: np.ndarray, word_shares: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights that start from the shares of the classes and of the words in each head class."""
    draw = np.random.default_rng(seed)
    normal = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
    log = lambda shares: np.clip(np.log(shares + 1e-5), -11.5, 0).astype(np.float32)
    return {
        "gates": normal(vocabulary.n_inputs, 3 * HIDDEN), "recurrent": normal(HIDDEN, 3 * HIDDEN) * 2,
        "class_weights": normal(HIDDEN, vocabulary.n_classes), "class_bias": log(class_shares),
        "word_weights": normal(vocabulary.n_head, HIDDEN, CLASS_WORDS), "word_bias": log(word_shares),
    }


def lanes_of(documents: list[np.ndarray], most_lanes: int = MOST_LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, owner, first), each [lane, step]: documents laid end to end in lanes of about equal length, longest first.

    owner is the document's number, -1 behind the last one; first marks where a document begins.
    """
    lengths = [len(one) for one in documents]
    total, longest = sum(lengths), max(lengths)
    count = int(max(1, min(most_lanes, total // longest, len(documents))))
    loads = [(0, lane) for lane in range(count)]
    placed: list[list[int]] = [[] for _ in range(count)]
    for number in sorted(range(len(documents)), key=lambda i: -lengths[i]):
        load, lane = heapq.heappop(loads)
        placed[lane].append(number)
        heapq.heappush(loads, (load + lengths[number], lane))
    steps = max(load for load, _ in loads)
    tokens, owner = np.zeros((count, steps), np.int32), np.full((count, steps), -1, np.int32)
    first = np.zeros((count, steps), bool)
    for lane, numbers in enumerate(placed):
        at = 0
        for number in numbers:
            tokens[lane, at : at + lengths[number]] = documents[number]
            owner[lane, at : at + lengths[number]] = number
            first[lane, at] = True
            at += lengths[number]
    return tokens, owner, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of numbers that are overwritten."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


class Gru:
    def __init__(self, vocabulary: Vocabulary, weights: dict[str, np.ndarray]):
        self.vocabulary, self.weights = vocabulary, weights

    def _inputs(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The row of the input table for each step: that of the token before, or of the start of a document."""
        before = np.zeros_like(tokens)
        before[:, 1:] = self.vocabulary.inputs[tokens[:, :-1]]
        before[first] = self.vocabulary.n_inputs - 1
        return before

    def _states(self, rows: np.ndarray, first: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """[lane, step, hidden]: the state that predicts each token. ``keep`` gets what the way back needs."""
        recurrent = self.weights["recurrent"]
        # [step, lane, ...], so that a step's numbers lie together.
        sums, begins = self.weights["gates"][rows.T], first.T
        result = np.empty((*rows.T.shape, HIDDEN), np.float32)
        for step, starts in enumerate(begins.any(axis=1).tolist()):
            if starts:
                state = state.copy()
                state[begins[step]] = 0
            x, u = sums[step], state @ recurrent
            gate = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            update, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
            new = reset * u[:, 2 * HIDDEN :]
            new += x[:, 2 * HIDDEN :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, update, reset, new, u[:, 2 * HIDDEN :]))
            state = state - new
            state *= update
            state += new
            result[step] = state
        return result.transpose(1, 0, 2)

    def log_probabilities(self, documents: list[np.ndarray]) -> np.ndarray:
        """For each document the natural log-likelihood of its tokens; words of tail classes count with their class alone.

        A document's state is carried from window to window, however long it is.
        """
        result = np.zeros(len(documents))
        if not documents:
            return result
        tokens, owner, first = lanes_of(documents)
        rows = self._inputs(tokens, first)
        state = np.zeros((len(tokens), HIDDEN), np.float32)
        for start in range(0, tokens.shape[1], WINDOW):
            part = slice(start, start + WINDOW)
            states = self._states(rows[:, part], first[:, part], state)
            state = states[:, -1]
            who = owner[:, part].ravel()
            there = np.flatnonzero(who >= 0)
            flat, ids = states.reshape(-1, HIDDEN)[there], tokens[:, part].ravel()[there]
            result += np.bincount(who[there], weights=self._token_logs(flat, ids), minlength=len(documents))
        return result

    def _token_logs(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        classes = self.vocabulary.classes[ids]
        logits = states @ self.weights["class_weights"]
        logits += self.weights["class_bias"]
        logs = logits[np.arange(len(ids)), classes].astype(np.float64)
        logs -= np.log(_row_sums(np.exp(logits, out=logits)))
        for number, chosen in self._by_class(classes):
            logits = states[chosen] @ self.weights["word_weights"][number]
            logits += self.weights["word_bias"][number]
            own = logits[np.arange(len(chosen)), self.vocabulary.places[ids[chosen]]]
            logs[chosen] += own - np.log(_row_sums(np.exp(logits, out=logits)))
        return logs

    def _by_class(self, classes: np.ndarray):
        small = classes.astype(np.int16)  # sorted by digits
        order = np.argsort(small, kind="stable")
        edges = np.searchsorted(small[order], np.arange(self.vocabulary.n_head + 1))
        for number in range(self.vocabulary.n_head):
            if edges[number] < edges[number + 1]:
                yield number, order[edges[number] : edges[number + 1]]

    def train(self, documents: list[np.ndarray], lanes: int | None = None) -> float:
        """One pass of truncated backpropagation over the documents, by Adam; the mean loss per token.

        States run on over the windows, gradients end at them.
        """
        lanes = lanes or sum(map(len, documents)) // (WINDOW * TRAINING_STEPS)
        tokens, owner, first = lanes_of(documents, min(max(lanes, 16), TRAINING_LANES))
        rows = self._inputs(tokens, first)
        state = np.zeros((len(tokens), HIDDEN), np.float32)
        moments = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in self.weights.items()}
        loss, count, step = 0.0, 0, 0
        for start in range(0, tokens.shape[1], WINDOW):
            part = slice(start, start + WINDOW)
            keep: list = []
            states = self._states(rows[:, part], first[:, part], state, keep)
            there = np.flatnonzero(owner[:, part].ravel() >= 0)
            gradients, window_loss = self._gradients(rows[:, part], first[:, part], states, keep, tokens[:, part].ravel()[there], there)
            state = states[:, -1]
            loss, count, step = loss + window_loss, count + len(there), step + 1
            for name, gradient in gradients.items():
                mean, square = moments[name]
                gradient *= np.float32(min(1.0, 5.0 / (np.linalg.norm(gradient) + 1e-8)))
                mean *= np.float32(0.9)
                mean += np.float32(0.1) * gradient
                square *= np.float32(0.99)
                gradient *= gradient
                gradient *= np.float32(0.01)
                square += gradient
                scale = LEARNING_RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                weights = self.weights[name]
                way = np.sqrt(square, out=gradient)
                way += np.float32(1e-7)
                np.divide(mean, way, out=way)
                way *= np.float32(scale)
                weights -= way
                np.clip(weights, -_CLIP[name], _CLIP[name], out=weights)
        return loss / max(count, 1)

    def _gradients(self, rows, first, states, keep, ids, there) -> tuple[dict[str, np.ndarray], float]:
        weights, n = self.weights, np.float32(max(len(ids), 1))
        flat = states.reshape(-1, HIDDEN)[there]
        classes = self.vocabulary.classes[ids]
        logits = flat @ weights["class_weights"]
        logits += weights["class_bias"]
        odds = np.exp(logits, out=logits)
        odds /= _row_sums(odds)[:, None]
        at = np.arange(len(ids))
        loss = -float(np.log(odds[at, classes] + 1e-30).sum())
        odds[at, classes] -= 1
        odds /= n
        gradients = {name: np.zeros_like(w) for name, w in weights.items()}
        gradients["class_weights"], gradients["class_bias"] = flat.T @ odds, odds.sum(axis=0)
        back = odds @ weights["class_weights"].T
        for number, chosen in self._by_class(classes):
            part = flat[chosen]
            odds = part @ weights["word_weights"][number]
            odds += weights["word_bias"][number]
            np.exp(odds, out=odds)
            odds /= _row_sums(odds)[:, None]
            at, places = np.arange(len(chosen)), self.vocabulary.places[ids[chosen]]
            loss -= float(np.log(odds[at, places] + 1e-30).sum())
            odds[at, places] -= 1
            odds /= n
            gradients["word_weights"][number], gradients["word_bias"][number] = part.T @ odds, odds.sum(axis=0)
            back[chosen] += odds @ weights["word_weights"][number].T
        into = np.zeros((states.shape[0] * states.shape[1], HIDDEN), np.float32)
        into[there] = back
        # [step, lane, ...], so that a step's numbers lie together.
        into = np.ascontiguousarray(into.reshape(states.shape).transpose(1, 0, 2))
        going_on = (~first.T[:, :, None]).astype(np.float32)
        back_through = np.ascontiguousarray(weights["recurrent"].T)
        carried = np.zeros((states.shape[0], HIDDEN), np.float32)
        # Of the sums for new, update and reset, and of what new sees of the state: all but the last reach the inputs, all but the first the state.
        sums = np.empty((*into.shape[:2], 4 * HIDDEN), np.float32)
        for step in range(len(keep) - 1, -1, -1):
            before, update, reset, new, u = keep[step]
            d, own = into[step], sums[step]
            d += carried
            d_update, d_new = d * update, own[:, :HIDDEN]
            np.subtract(d, d_update, out=d_new)
            d_new -= d_new * new * new
            by_update = before - new
            by_update *= 1 - update
            np.multiply(d_update, by_update, out=own[:, HIDDEN : 2 * HIDDEN])
            seen = np.multiply(d_new, reset, out=own[:, 3 * HIDDEN :])
            by_reset = 1 - reset
            by_reset *= u
            np.multiply(seen, by_reset, out=own[:, 2 * HIDDEN : 3 * HIDDEN])
            carried = own[:, HIDDEN:] @ back_through
            carried += d_update
            carried *= going_on[step]
            gradients["recurrent"] += before.T @ own[:, HIDDEN:]
        order = np.argsort(rows.T.astype(np.uint16) if self.vocabulary.n_inputs <= 1 << 16 else rows.T, axis=None, kind="stable")
        own = rows.T.ravel()[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        of_inputs = np.add.reduceat(sums.reshape(-1, 4 * HIDDEN)[order, : 3 * HIDDEN], starts, axis=0)
        gradients["gates"][own[starts]] = np.roll(of_inputs, -HIDDEN, axis=1)
        return gradients, loss
