"""The three pieces: card cube (``cube``), survey star schema (``star``),
warehouse SQL patterns (``warehouse``); ``registry`` names the queries."""
