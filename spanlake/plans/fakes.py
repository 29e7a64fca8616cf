"""Deterministic stand-ins for the user-supplied model and text client, used by the
registered inference queries and the tests (no network, no model weights)."""

from __future__ import annotations

import hashlib


def table_predictor(classes: dict, default: int = 2):
    """A span predictor backed by a table: the class of a position is the table's entry for
    its token id (``default`` for ids outside it) after the separator, and the pad label 4
    in the query prefix (segment 0) and where the mask is 0.  Returns the factory."""
    def factory():
        import numpy as np
        size = max(classes, default=0) + 1
        table = np.full(size, default, dtype=np.int64)
        table[list(classes)] = list(classes.values())
        eye = np.eye(5)

        def predict(batch):
            out = []
            for ids, segments, mask in zip(batch["ids"], batch["segments"], batch["mask"]):
                ids = np.asarray(ids, dtype=np.int64)
                if segments is None:
                    out.append(eye[np.full(len(ids), 4)])
                    continue
                known = (ids >= 0) & (ids < size)
                cls = np.where(known, table[np.where(known, ids, 0)], default)
                body = (np.asarray(segments) == 1) & (np.asarray(mask) == 1)
                out.append(eye[np.where(body, cls, 4)])
            return out
        return predict
    return factory


def parity_relevance():
    """Two-class block scorer: class = parity of the masked body ids' sum."""
    import numpy as np

    def predict(batch):
        out = []
        for ids, segments, mask in zip(batch["ids"], batch["segments"], batch["mask"]):
            odd = int((np.asarray(ids) * np.asarray(segments) * np.asarray(mask)).sum()) % 2
            out.append([0.0, 1.0] if odd else [1.0, 0.0])
        return out
    return predict


def digest(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def echo_client():
    """Text client: n choices per prompt built from the prompt's last non-empty line; a
    prompt whose md5 starts with '0' is always rate-limited, with '1' is rejected, with
    '2' returns the wrong number of choices; choice 9 is blank."""
    from spanlake.operators.inference import InvalidRequestError, RateLimitError

    def call(prompts, n, instructions=None):
        out = []
        for k, p in enumerate(prompts):
            h = digest(p)
            if h[0] == "0":
                raise RateLimitError("slow down")
            if h[0] == "1":
                raise InvalidRequestError("rejected")
            if h[0] == "2":
                return [{"text": "x", "finish_reason": "stop"}]
            lines = [line for line in p.split("\n") if line.strip()]
            base = lines[-1] if lines else ""
            extra = f" [{instructions[k]}]" if instructions else ""
            for j in range(n):
                text = "  " if j == 9 else f"{base}{extra} #{j}"
                out.append({"text": text, "finish_reason": "stop"})
        return out
    return call
