"""The credit feature table: cleaning, history roll-ups, building, scoring."""
