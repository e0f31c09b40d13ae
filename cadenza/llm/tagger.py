"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding.

Gates and states use x / (1 + |x|), scaled to 0..1 for gates, in place of sigmoid and tanh: it's several
times cheaper in numpy and trained with its own derivative. Whole texts are read in overlapping windows; their
emissions are blended over the overlaps, and the best path runs through the whole text. Stretches in
which no path but that of no span can be best are left out of the search, by an exact bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
#: Tag 0 is no span; 1 + 2 * k begins kind k, 2 + 2 * k goes on in it.
TAGS = 1 + 2 * len(KINDS)
#: Characters have classes: ASCII by themselves, other letters, other characters, and padding.
CLASSES = 131
WINDOW, OVERLAP = 512, 48
#: Windows that are read at once, and lengths that texts shorter than a window are padded to.
BATCH, STEP = 1024, 64
#: Longer texts are read as a stream of windows.
LONG = 400_000
#: An emission that rules a tag out, and what a window that isn't read says of all tags but 0.
NEVER, QUIET = -1e4, -50.0


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x2000, 128, 129)).astype(np.uint8)


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray] | None = None, size: int = 10, embed: int = 12, seed: int = 11):
        if weights is not None:
            self.w = weights
        else:
            r = np.random.default_rng(seed)
            b = np.zeros((2, 4 * size))
            b[:, size : 2 * size] = 2
            self.w = {
                "E": r.normal(0, 0.5, (CLASSES, embed)),
                "W": r.normal(0, 2 / np.sqrt(embed), (2, embed, 4 * size)),
                "U": r.normal(0, 2 / np.sqrt(size), (2, size, 4 * size)),
                "b": b,
                "O": r.normal(0, 1 / np.sqrt(size), (2 * size, TAGS)),
                "o": np.zeros(TAGS),
                "T": np.zeros((TAGS, TAGS)),
            }
        self.size = self.w["U"].shape[1]
        self.ready = None

    def loss(self, ids: np.ndarray, tags: np.ndarray, margin: float = 0.0) -> tuple[float, dict]:
        """Negative log-likelihood a character, and its gradients. Both directions run side by side.

        Tags other than the right one get ``margin`` added to their emissions, so that the right one has to lead by it.
        """
        w, (n, t), s, kind = self.w, ids.shape, self.size, self.w["E"].dtype
        both = np.stack([ids, ids[:, ::-1]])
        x = w["E"][both]
        pre = np.matmul(x.reshape(2, n * t, -1), w["W"]).reshape(2, n, t, 4 * s) + w["b"][:, None, None]
        h = c = np.zeros((2, n, s), kind)
        out, kept = np.empty((2, n, t, s), kind), []
        for k in range(t):
            y = _soft(pre[:, :, k] + np.matmul(h, w["U"]))
            gates = 0.5 + 0.5 * y[..., : 3 * s]
            i, f, o, g = gates[..., :s], gates[..., s : 2 * s], gates[..., 2 * s :], y[..., 3 * s :]
            new = f * c + i * g
            tc = _soft(new)
            kept.append((h, c, y, i, f, o, g, tc))
            h, c = o * tc, new
            out[:, :, k] = h
        hidden = np.concatenate([out[0], out[1][:, ::-1]], 2)
        rows = np.arange(n)[:, None]
        e = hidden @ w["O"] + w["o"] + margin
        e[rows, np.arange(t), tags] -= margin
        # Scaled forward and backward sums.
        top = e.max(2, keepdims=True)
        ee, eT = np.exp(e - top), np.exp(w["T"])
        ahead, back, scale = np.empty((t, n, TAGS), kind), np.ones((t, n, TAGS), kind), np.empty((t, n, 1), kind)
        now = ee[:, 0]
        for k in range(t):
            if k:
                now = (ahead[k - 1] @ eT) * ee[:, k]
            scale[k] = now.sum(1, keepdims=True)
            ahead[k] = now / scale[k]
        for k in range(t - 2, -1, -1):
            back[k] = ((back[k + 1] * ee[:, k + 1]) @ eT.T) / scale[k + 1]
        total = np.log(scale).sum((0, 2)) + top.sum((1, 2))
        gold = e[rows, np.arange(t), tags].sum(1) + w["T"][tags[:, :-1], tags[:, 1:]].sum(1)
        de = (ahead * back).transpose(1, 0, 2)
        de[rows, np.arange(t), tags] -= 1
        later = back[1:] * ee.transpose(1, 0, 2)[1:] / scale[1:]
        dT = eT * (ahead[:-1].reshape(-1, TAGS).T @ later.reshape(-1, TAGS))
        np.add.at(dT, (tags[:, :-1], tags[:, 1:]), -1)
        grad = {"T": dT, "o": de.sum((0, 1)), "O": hidden.reshape(-1, 2 * s).T @ de.reshape(-1, TAGS)}
        dhidden = de @ w["O"].T
        dout = np.stack([dhidden[:, :, :s], dhidden[:, ::-1, s:]])
        dpre = np.empty_like(pre)
        dh, dc, dU = np.zeros((2, n, s), kind), np.zeros((2, n, s), kind), np.zeros_like(w["U"])
        for k in range(t - 1, -1, -1):
            h, c, y, i, f, o, g, tc = kept[k]
            dh = dh + dout[:, :, k]
            dc = dc + dh * o * (1 - np.abs(tc)) ** 2
            z = np.concatenate([0.5 * dc * g, 0.5 * dc * c, 0.5 * dh * tc, dc * i], 2) * (1 - np.abs(y)) ** 2
            dpre[:, :, k] = z
            dU += np.matmul(h.transpose(0, 2, 1), z)
            dh, dc = np.matmul(z, w["U"].transpose(0, 2, 1)), dc * f
        flat = dpre.reshape(2, n * t, 4 * s)
        grad["U"], grad["b"], grad["W"] = dU, flat.sum(1), np.matmul(x.reshape(2, n * t, -1).transpose(0, 2, 1), flat)
        dx = np.matmul(flat, w["W"].transpose(0, 2, 1)).reshape(-1, x.shape[3])
        grad["E"] = np.stack([np.bincount(both.ravel(), dx[:, j], CLASSES) for j in range(dx.shape[1])], 1)
        return float((total - gold).sum() / (n * t)), {k: v / (n * t) * 8 for k, v in grad.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 900, batch: int = 40, rate: float = 0.02, margin: float = 2.0, seed: int = 3) -> list[float]:
        """Adam over random batches of windows (rows of ids and tags), in single precision; returns the losses."""
        r, losses = np.random.default_rng(seed), []
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            take = r.integers(0, len(ids), batch)
            loss, grad = self.loss(ids[take], tags[take], margin)
            losses.append(loss)
            now = rate * (1 - 0.95 * step / steps)
            for k, g in grad.items():
                g = np.clip(g, -1, 1).astype(np.float32)
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                self.w[k] = self.w[k] - now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
        self.ready = None
        return losses

    def _prepared(self) -> dict[str, np.ndarray]:
        """Single-precision weights: of each direction a table of what a class adds to the gates, and U; columns are windows."""
        if self.ready is None:
            w = self.w
            tables = (np.matmul(w["E"], w["W"]) + w["b"][:, None]).transpose(0, 2, 1)
            self.ready = {k: np.ascontiguousarray(v, np.float32) for k, v in (("table", tables), ("U", w["U"].transpose(0, 2, 1)), ("O", w["O"].reshape(2, self.size, TAGS).transpose(0, 2, 1)), ("o", w["o"][:, None]))}
        return self.ready

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Emissions (time, TAGS, windows) of windows (windows, time) of classes."""
        p, s = self._prepared(), self.size
        n, t = ids.shape
        at = np.ascontiguousarray(ids.T).astype(np.intp)
        e = np.empty((t, TAGS, n), np.float32)
        z, m = np.empty((4 * s, n), np.float32), np.empty((4 * s, n), np.float32)
        u, part = np.empty((s, n), np.float32), np.empty((TAGS, n), np.float32)
        for d in (0, 1):
            h, c = np.zeros((s, n), np.float32), np.zeros((s, n), np.float32)
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                np.take(p["table"][d], at[k], axis=1, out=z, mode="clip")
                np.matmul(p["U"][d], h, out=m)
                z += m
                np.abs(z, out=m)
                m += 1
                z /= m
                gates = z[: 3 * s]
                gates *= 0.5
                gates += 0.5
                c *= z[s : 2 * s]
                np.multiply(z[:s], z[3 * s :], out=u)
                c += u
                np.abs(c, out=u)
                u += 1
                np.divide(c, u, out=u)
                np.multiply(z[2 * s : 3 * s], u, out=h)
                if d == 0:
                    np.matmul(p["O"][0], h, out=e[k])
                else:
                    np.matmul(p["O"][1], h, out=part)
                    e[k] += part
        e += p["o"]
        return e

    def spans(self, texts: list[str], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> list[list[tuple[int, int, int, float]]]:
        """(kind, begin, end, mean odds) of the spans of each text, read as a whole.

        A text is covered by evenly spaced windows that overlap by OVERLAP characters or more. Around the middle
        of an overlap emissions are blended from the one window to the other, over OVERLAP characters, so that the
        windows are reconciled before one path is decoded for the whole text. A text's result depends on
        nothing but the text. ``wanted`` tells of classes which characters matter: stretches of the path without
        any such character, whose spans nobody wants, aren't decoded, and windows that have none and stand beside none that has
        are taken to be quiet without being read.
        """
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for k, text in enumerate(texts):
            if len(text) > LONG:
                out[k] = list(self._streamed(text, wanted))
        texts = ["" if len(t) > LONG else t for t in texts]
        length = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(length) - length
        ids = classes("".join(texts))
        if not len(ids):
            return out
        windows = _Windows(length, base)
        lead = np.zeros(len(ids), np.float32)
        begin, end, slack = self._debts()
        many = np.concatenate([[0], np.cumsum(wanted(ids))]) if wanted is not None else np.arange(len(ids) + 1)
        read = windows.beside(many[windows.begin + windows.size] > many[windows.begin])
        for own, at, inside in windows.groups(read):
            e = self.emissions(np.where(inside, ids[at], CLASSES - 1))
            windows.keep(own, e)
            windows.add(lead, self._leads(e), own, at, inside)
        for own, at, inside in windows.groups(~read):
            windows.add(lead, np.full(inside.shape, -QUIET, np.float32), own, at, inside)
        full = length > 0
        lead[base[full]] -= begin
        lead[(base + length - 1)[full]] -= end
        where = list(_loud(lead, slack, base))
        where = [w for w in where if many[w[2]] > many[w[1]]]
        # Within a text the stretches begin and end beside tag 0; a row for it is put there and taken away.
        cut = [(bool(a > base[t]), bool(b < base[t] + length[t])) for t, a, b in where]
        for (t, a, _), (x, y), (tags, odds) in zip(where, cut, self._paths([windows.emissions(*w, *c) for w, c in zip(where, cut)])):
            tags, odds = tags[x : len(tags) - y], odds[x : len(odds) - y]
            out[t] += [(k, x + a - int(base[t]), y + a - int(base[t]), q) for k, x, y, q in tagged_spans(tags, odds)]
        return out

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        """What a tag owes for the way back to tag 0; with it, a step into tag j brings at most step[j]."""
        T = self.w["T"]
        cost = T[0, 0] - T[:, 0]
        return cost, (T + cost[:, None] - cost).max(0).astype(np.float32)

    def _debts(self) -> tuple[float, float, float]:
        """By how much a text's first and last characters have to lead more, as a path may begin or end in any tag; and ``_loud``'s slack."""
        T, (cost, step) = self.w["T"], self._steps()
        return max(0.0, float((T[0, 0] - cost - step).max())), max(0.0, float(cost.max())), float((step - T[0] + cost)[1:].max()) + 1e-3

    def _leads(self, e: np.ndarray) -> np.ndarray:
        """By how much tag 0 is ahead of all others at each character of windows, whatever steps lead there."""
        _, step = self._steps()
        most = e[:, 1] + step[1]
        for j in range(2, TAGS):
            np.maximum(most, e[:, j] + step[j], out=most)
        return (e[:, 0] + np.float32(self.w["T"][0, 0]) - most).T

    def _streamed(self, text: str, wanted: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[tuple[int, int, int, float]]:
        """As ``spans`` for one long text: stretches are decoded as windows get done, and what lies behind them is dropped.

        What's held grows with the longest stretch that has to be decoded as one, not with the text.
        """
        n = len(text)
        windows = _Windows(np.array([n]), np.array([0]))
        begin, end, slack = self._debts()
        many, low, lead = len(windows.begin), 0, np.zeros(0, np.float32)  # lead: of the characters from low on
        has = np.ones(many, bool)
        for first in range(0, many if wanted is not None else 0, BATCH):
            some = slice(first, first + BATCH)
            a, b = windows.begin[some], windows.begin[some] + windows.size[some]
            before = max(0, int(a[0]) - 2)
            sums = np.concatenate([[0], np.cumsum(wanted(classes(text[before : int(b[-1]) + 1])))])
            has[some] = sums[b - before] > sums[a - before]
        read = windows.beside(has)
        for first in range(0, many, BATCH):
            own = np.arange(first, min(first + BATCH, many))
            reach = int(windows.begin[own[-1]] + windows.size[own[-1]])
            at = windows.begin[own, None] + np.arange(int(windows.padded[0]))
            inside = np.arange(at.shape[1]) < windows.size[own, None]
            start = int(at[0, 0])
            ids = classes(text[start:reach])
            lead = np.concatenate([lead, np.zeros(reach - low - len(lead), np.float32)])
            for loud in (True, False):
                if not len(some := np.flatnonzero(read[own] == loud)):
                    continue
                if loud:
                    e = self.emissions(np.where(inside[some], ids[np.minimum(at[some] - start, len(ids) - 1)], CLASSES - 1))
                    windows.keep(own[some], e)
                leads = self._leads(e) if loud else np.full(inside[some].shape, -QUIET, np.float32)
                windows.add(lead, leads, own[some], np.where(inside[some], at[some] - low, 0), inside[some])
            over = own[-1] == many - 1
            if first == 0:
                lead[0] -= begin
            if over:
                lead[n - 1 - low] -= end
            # No later window reaches the characters before ``done``.
            done = n if over else int(windows.begin[own[-1] + 1])
            known = lead[: done - low]
            sums = np.concatenate([[0.0], np.cumsum(np.maximum(known, 0), dtype=np.float64)])
            where = [(low + a, low + b) for _, a, b in _loud(known, slack, np.zeros(1, np.int64))]
            loud = np.flatnonzero(known <= 0)
            behind = int(np.searchsorted(sums, sums[-1] - 2 * slack, "left")) - 1  # leads from there on part what comes from what was
            if not over and len(loud) and sums[-1] - sums[loud[-1] + 1] <= 2 * slack:
                behind = min(behind, where.pop()[0] - low)  # it may go on
            around = max(0, low - 2)
            kept = np.concatenate([[0], np.cumsum(wanted(classes(text[around : done + 1]))[low - around :])]) if wanted is not None else None
            where = [w for w in where if kept is None or kept[w[1] - low] > kept[w[0] - low]]
            cut = [(a > 0, b < n) for a, b in where]
            for (a, _), (x, y), (tags, odds) in zip(where, cut, self._paths([windows.emissions(0, *w, *c) for w, c in zip(where, cut)])):
                yield from ((k, p + a, q + a, o) for k, p, q, o in tagged_spans(tags[x : len(tags) - y], odds[x : len(odds) - y]))
            behind = max(behind, 0)
            low, lead = low + behind, lead[behind:]
            for k in [k for k in windows.kept if windows.begin[k] + WINDOW <= low]:
                del windows.kept[k]

    def _paths(self, parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The best tags of each stretch of emissions and their marginal odds; stretches of like lengths go together."""
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        done: list = [None] * len(parts)
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 512 and len(parts[order[to]]) <= 1.25 * len(parts[order[at]]) + 8:
                to += 1
            own = order[at:to]
            for k, found in zip(own, self._decoded([parts[k] for k in own])):
                done[k] = found
            at = to
        yield from done

    def _decoded(self, parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        T, n = self.w["T"], len(parts)
        size = np.array([len(p) for p in parts])
        t = int(size.max())
        e = np.zeros((t, n, TAGS))
        for k, p in enumerate(parts):
            e[: len(p), k] = p
        best, came = e[0], np.zeros((t, n, TAGS), np.int8)
        eT, ee = np.exp(T), np.exp(e - e.max(2, keepdims=True))
        ahead, back, scale = np.empty((t, n, TAGS)), np.ones((t, n, TAGS)), np.ones((t, n, 1))
        ahead[0] = ee[0] / ee[0].sum(1, keepdims=True)
        last = best.argmax(1)
        for k in range(1, t):
            step = best[:, :, None] + T
            came[k] = step.argmax(1)
            best = step.max(1) + e[k]
            last = np.where(k < size, best.argmax(1), last)
            now = (ahead[k - 1] @ eT) * ee[k]
            scale[k] = now.sum(1, keepdims=True)
            ahead[k] = now / scale[k]
        for k in range(t - 2, -1, -1):
            back[k] = np.where((k < size - 1)[:, None], ((back[k + 1] * ee[k + 1]) @ eT.T) / scale[k + 1], 1)
        rows, tags = np.arange(n), np.zeros((t, n), np.int64)
        tags[-1] = last
        for k in range(t - 1, 0, -1):
            tags[k - 1] = np.where(k < size, came[k, rows, tags[k]], last)
        odds = np.take_along_axis(ahead * back, tags[:, :, None], 2)[:, :, 0]
        for k in range(n):
            yield tags[: size[k], k], odds[: size[k], k]


class _Windows:
    """The windows of texts that lie end to end, and their emissions."""

    def __init__(self, length: np.ndarray, base: np.ndarray):
        many = np.where(length > WINDOW, -(-(length - OVERLAP) // (WINDOW - OVERLAP)), np.minimum(length, 1))
        self.first = np.cumsum(many) - many
        self.text = np.repeat(np.arange(len(length)), many)
        number = np.arange(len(self.text)) - self.first[self.text]
        apart = np.maximum(many - 1, 1)[self.text]
        room = np.maximum(length[self.text] - WINDOW, 0)
        begin = number * room // apart
        self.odd = number % 2
        self.many, self.base, self.length = many, base, length
        self.begin = base[self.text] + begin
        self.size = np.minimum(WINDOW, length[self.text])
        self.padded = np.minimum(WINDOW, -(-self.size // STEP) * STEP)
        # Where a window takes over from the one before it, and hands over to the next one: the middles of the overlaps.
        last = number == many[self.text] - 1
        before, after = (number - 1) * room // apart + WINDOW, (number + 1) * room // apart
        self.enter = np.where(number == 0, -WINDOW, (begin + before) // 2 - begin)
        self.leave = np.where(last, 2 * WINDOW, (after + begin + WINDOW) // 2 - begin)
        self.kept: dict[int, tuple[np.ndarray, int]] = {}

    def beside(self, has: np.ndarray) -> np.ndarray:
        """The windows that are marked, and those beside them in the same text."""
        out, same = has.copy(), self.text[1:] == self.text[:-1]
        out[1:] |= has[:-1] & same
        out[:-1] |= has[1:] & same
        return out

    def groups(self, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of one padded length, all or those marked: their numbers, their characters' places, and which of these are in the text."""
        which = np.ones(len(self.padded), bool) if which is None else which
        for width in np.unique(self.padded[which]):
            own = np.flatnonzero((self.padded == width) & which)
            for chunk in (own[k : k + BATCH] for k in range(0, len(own), BATCH)):
                inside = np.arange(width) < self.size[chunk, None]
                yield chunk, np.where(inside, self.begin[chunk, None] + np.arange(width), 0), inside

    def weight(self, own, width: int) -> np.ndarray:
        place = np.arange(width)
        rise = (place - (self.enter[own, None] - OVERLAP // 2) + 0.5) / OVERLAP
        fall = (self.leave[own, None] + OVERLAP // 2 - place - 0.5) / OVERLAP
        return np.clip(np.minimum(rise, fall), 0, 1).astype(np.float32)

    def keep(self, own: np.ndarray, e: np.ndarray) -> None:
        for column, k in enumerate(own.tolist()):
            self.kept[k] = e, column

    def add(self, total: np.ndarray, values: np.ndarray, own: np.ndarray, at: np.ndarray, inside: np.ndarray) -> None:
        """Adds the windows' values, blended, to the characters' total; those of one parity never meet."""
        weight = self.weight(own, values.shape[1])
        for odd in (0, 1):
            take = inside & (weight > 0) & (self.odd[own] == odd)[:, None]
            total[at[take]] += (values * weight)[take]

    def emissions(self, text: int, a: int, b: int, before: bool = False, after: bool = False) -> np.ndarray:
        """Blended emissions of the characters [a, b) of one text, with rows for tag 0 alone before and after them."""
        rows = np.zeros((b - a + before + after, TAGS), np.float32)
        if before:
            rows[0, 1:] = NEVER
        if after:
            rows[-1, 1:] = NEVER
        out = rows[before : before + b - a]
        first = int(self.first[text])
        begins = self.begin[first : first + int(self.many[text])]
        low = max(0, int(np.searchsorted(begins, a - WINDOW, "right")))
        for k in range(first + low, first + int(np.searchsorted(begins, b, "left"))):
            begin = int(self.begin[k])
            x, y = max(a, begin), min(b, begin + int(self.size[k]))
            if x >= y:
                continue
            if k in self.kept:
                e, column = self.kept[k]
                part = e[x - begin : y - begin, :, column]
            else:
                part = np.where(np.arange(TAGS) > 0, np.float32(QUIET), np.float32(0)) * np.ones((y - x, 1), np.float32)
            if x - begin < self.enter[k] + OVERLAP // 2 or y - begin > self.leave[k] - OVERLAP // 2:
                part = part * self.weight([k], int(self.padded[k]))[0, x - begin : y - begin, None]
            out[x - a : y - a] += part
        return rows


def _loud(lead: np.ndarray, slack: float, base: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) of stretches outside of which the best path has tag 0.

    lead: by how much tag 0 is ahead of all others whatever steps lead there. Where it's ahead, a detour through
    other tags loses; detours are cut off where the leads add up to slack, the most that going out again costs.
    A blend's lead is no less than the blend of leads.
    """
    loud = np.flatnonzero(lead <= 0)
    if not len(loud):
        return
    ends = np.append(base[1:], len(lead))
    own = np.searchsorted(ends, loud, "right")
    sums = np.concatenate([[0.0], np.cumsum(np.maximum(lead, 0), dtype=np.float64)])
    # A cut between two loud characters: another text, or enough leads between them for both sides.
    apart = (own[1:] != own[:-1]) | (sums[loud[1:]] - sums[loud[:-1] + 1] > 2 * slack)
    starts, stops = np.concatenate([[True], apart]), np.concatenate([apart, [True]])
    for t, a, b in zip(own[starts].tolist(), loud[starts].tolist(), (loud[stops] + 1).tolist()):
        # Out to where the leads reach the slack, within the text.
        a = max(int(base[t]), int(np.searchsorted(sums, sums[a] - slack, "left")) - 1)
        b = min(int(ends[t]), int(np.searchsorted(sums, sums[b] + slack, "left")) + 1)
        yield t, a, b


def tagged_spans(tags: np.ndarray, odds: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, begin, end, mean odds) of the spans in tags; one that goes on without a begin begins there."""
    out: list[list] = []
    for i in np.flatnonzero(tags).tolist():
        tag = int(tags[i])
        kind = (tag - 1) // 2
        if tag % 2 or not out or out[-1][0] != kind or out[-1][2] != i:
            out.append([kind, i, i + 1])
        else:
            out[-1][2] = i + 1
    return [(k, a, b, float(odds[a:b].mean())) for k, a, b in out]
