"""DataFrame operators over holons, evidence, relations, waivers and audit rows."""
