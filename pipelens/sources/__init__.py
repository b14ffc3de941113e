"""Where frames come from and go to. Every source gives rows a stable id, `_rid`."""
