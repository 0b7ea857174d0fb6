"""A feed of three pages a window, for tests: asked for in the tasks, kept in a folder."""

import os


def fetch(url: str, params: dict[str, str]) -> str:
    day, n = params["resumptionToken"].split("&") if "resumptionToken" in params else (params["from"], "0")
    if n == "2" and day == "2010-01-02" and os.path.exists(f"{url}/broken"):
        raise OSError("the feed is down")
    with open(f"{url}/log", "a") as f:
        f.write(f"{day} {n}\n")
    if day == "2010-01-03":
        return "<OAI-PMH><error code='noRecordsMatch'>none</error></OAI-PMH>"
    token = f"<resumptionToken>{day}&amp;{int(n) + 1}</resumptionToken>" if n < "2" else "<resumptionToken/>"
    record = f"<record><header><identifier>oai:{day}:{n}</identifier></header><metadata><dc><title>Ä {n}</title><creator>A B</creator></dc></metadata></record>"
    return f"<OAI-PMH><ListRecords>{record}{token}</ListRecords></OAI-PMH>"
