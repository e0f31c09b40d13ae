"""Encoders of many runs at once for the two libraries; see runs.py."""

from __future__ import annotations

import os

import numpy as np

from .runs import cuts_at_spaces, dealt


#: Runs that the library is given as one text.
JOINED = 500


class JsonEncoder:
    """A tokenizers file: no added special tokens, no truncation, no padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_runs = cuts_at_spaces(text)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.size = max(vocab.values()) + 1
        self.width = np.zeros(self.size, np.int64)
        for token, i in vocab.items():  # of a byte-level token each character stands for a byte
            self.width[i] = len(token.encode()) if token in added else len(token)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, runs: list[str], spaced: bool) -> tuple[np.ndarray, list[int]]:
        """The ids of all runs, end to end, and where those of each run end."""
        if spaced and runs:
            ids = np.concatenate(self.whole([" " + " ".join(runs[k : k + JOINED]) for k in range(0, len(runs), JOINED)]))
            if (ends := dealt(ids, self.width, runs)) is not None:
                return ids, ends.tolist()
        return self.each(runs, spaced)

    def each(self, runs: list[str], spaced: bool) -> tuple[np.ndarray, list[int]]:
        """The same, with every run encoded as a text of its own."""
        return _together(self.whole([" " * spaced + run for run in runs]))


class PieceEncoder:
    """A SentencePiece model: no begin or end ids, no sampling."""

    def __init__(self, path: str):
        import sentencepiece

        from .charsmap import normalizer_spec

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spec = normalizer_spec(self.model.serialized_model_proto())
        self.size = self.model.get_piece_size()
        self.texts = [str(i) for i in range(self.size)]
        m = self.model
        self.surface = [b"\0" if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]
        self.width = np.array([0 if m.is_unknown(i) or m.is_control(i) else len(s) for i, s in enumerate(self.surface)], np.int64)
        inner = any("▁" in p.lstrip("▁") for p in map(m.id_to_piece, range(self.size)))
        # Runs are independent only if nothing is normalised and no piece holds a space after another character.
        s = self.spec
        self.by_runs = not s.charsmap and s.dummy_prefix and not s.strip_spaces and s.escape and not inner

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]

    def runs(self, runs: list[str], spaced: bool) -> tuple[np.ndarray, list[int]]:
        """As above; the same for spaced runs and first ones, as the model puts a space before a text."""
        if runs:
            ids = np.concatenate(self.whole([" ".join(runs[k : k + JOINED]) for k in range(0, len(runs), JOINED)]))
            if (ends := dealt(ids, self.width, runs)) is not None:
                return ids, ends.tolist()
        return self.each(runs, spaced)

    def each(self, runs: list[str], spaced: bool) -> tuple[np.ndarray, list[int]]:
        return _together(self.whole(runs))


def _together(each: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    return np.concatenate(each) if each else np.zeros(0, np.int64), np.cumsum([len(x) for x in each]).tolist()


def load(path: str) -> JsonEncoder | PieceEncoder:
    return JsonEncoder(path) if path.endswith(".json") else PieceEncoder(path)
