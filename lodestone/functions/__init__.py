"""Column functions: text cleaning, titles, links, tokens, scoring arithmetic. All are Catalyst expressions."""
