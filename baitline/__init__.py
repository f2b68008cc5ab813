"""Baitline: phishing-risk analytics over tables and streams of URLs, on Spark."""
