"""End-to-end plans (sample build, prompt generation, evaluation) and fixture views."""
