"""Readers and adapters: feeds, shop-API exports, posts, collected pages."""
