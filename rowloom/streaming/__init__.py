"""Scoring of requests that arrive as a stream."""

from rowloom.streaming.joined import joined_answers, score_requests_joined, stored_answers
from rowloom.streaming.requests import score_request_stream

__all__ = ["joined_answers", "score_request_stream", "score_requests_joined", "stored_answers"]
