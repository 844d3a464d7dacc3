"""Scam and phishing analytics over tables and streams of URLs, pages and messages."""
