"""Models for tests: they take down in files what they were given, as they run in workers."""

import os
import time
import uuid

import numpy as np
import pandas as pd


class Letters:
    """Vectors of letter counts; with a folder a file for each load and one for each text."""

    def __init__(self, folder=None):
        self.folder, self.fingerprint = folder, "letters"

    def __setstate__(self, state):
        self.__dict__ = state
        if self.folder:
            open(f"{self.folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def encode(self, texts):
        for _ in texts if self.folder else ():
            open(f"{self.folder}/text-{uuid.uuid4().hex}", "w").close()
        return texts.map(lambda t: [t.lower().count(c) + 1e-3 for c in "abcdefghijklmnopqrstuvwxyz"])


class Longest:
    def predict(self, questions, texts):
        return texts.map(lambda t: float(len(t)))


class Slow(Longest):
    def predict(self, questions, texts):
        time.sleep(0.6)
        return super().predict(questions, texts)


class Characters:
    """Each character is a token."""

    def ends(self, texts):
        return pd.Series([np.arange(1, len(t) + 1) for t in texts], index=texts.index, dtype=object)


def busy_server(delay=0.0, failures=0):
    """(server, state): answers after a delay, the first calls with 503; state counts calls and how many were under way at once."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    state, lock = {"calls": 0, "now": 0, "most": 0, "prompts": [], "broken": False}, threading.Lock()

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            with lock:
                state["calls"] += 1
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                fails = state["calls"] <= failures
                bad = state["broken"] and "bad" in asked
                if not (fails or bad):
                    state["prompts"].append(asked)
            time.sleep(delay)
            with lock:
                state["now"] -= 1
            body = json.dumps({"choices": [{"message": {"content": asked.upper()}}]}).encode()
            self.send_response(400 if bad else 503 if fails else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    return http, state
