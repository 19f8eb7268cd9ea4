"""Named query plans over the bound views, and their SQL oracles."""
